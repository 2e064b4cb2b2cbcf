"""Removal of repeated passages against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from pagetide.llm.suffix_dedup import PLACE, WHOLE, gram_hashes, minimizers, remove_repeats, removed_runs, sliding


def brute(rows, width=50):
    seen, out = set(), []
    for i, text in sorted(rows):
        data = (text or "").encode()
        strings = [data[k:k + width] for k in range(len(data) - width + 1)]
        gone = bytearray(len(data))
        for k, s in enumerate(strings):
            if s in seen:
                gone[k:k + width] = b"\1" * width
        seen.update(strings)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return out


def result(df):
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept_bytes"])) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_equal_brute_force(frame, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (9, 12, 20, 60, 300)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [" ".join(word() for _ in range(rng.randrange(0, 30))), p if rng.random() < 0.5 else p[a:a + rng.randrange(40, 120)]]
        rows.append((i, " ".join(parts)))
    rows += [(100, "a" * 300), (101, "a" * 120), (102, "ab" * 100), (103, "a" * 49), (104, rows[3][1]), (105, rows[3][1] + "!")]
    rng.shuffle(rows)
    assert result(remove_repeats(frame(rows))) == brute(rows)


def test_odd_rows(frame, odd, empty):
    got = remove_repeats(frame(odd)).collect()
    kept = {(r["doc_id"], r["text"]): bytes(r["kept_bytes"]) for r in got}
    assert len(got) == len(odd) and kept[(1, None)] == b"" and kept[(5, odd[4][1])] == odd[4][1].encode() and kept[(6, odd[4][1])] == b""
    assert kept[(None, odd[4][1])] == odd[4][1].encode()
    assert remove_repeats(empty).count() == 0
    texts = {r["doc_id"]: r["kept_text"] for r in remove_repeats(frame([(1, "é" * 40), (2, "xé" + "é" * 40)]), as_text=True).collect()}
    assert texts[1] == "é" * 40 and texts[2] == "x"


def test_every_string_holds_a_minimizer():
    data = np.frombuffer(random.Random(3).randbytes(5000), np.uint8) % 5
    at, _, lows = minimizers(data.astype(np.uint8))
    assert len(lows) == len(data) - 49
    assert np.diff(at).max() <= 31 and at[0] <= 30 and at[-1] >= len(data) - 50
    values = np.array([5, 1, 4, 2, 9, 0, 3], np.uint64)
    assert sliding(values, 3, True).tolist() == [1, 1, 2, 0, 0] and sliding(values, 3, False).tolist() == [5, 4, 9, 9, 9]


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_minimizers_of_texts_end_to_end(letters):
    rng = np.random.default_rng(letters)
    sizes = np.array([0, 130, 49, 50, 0, 400, 20])
    data = rng.integers(97, 97 + letters, sizes.sum()).astype(np.uint8)
    at, (first, end), _ = minimizers(data, sizes=sizes)
    got = [(q, int(p)) for p, b, e in zip(at, first, end, strict=True) for q in range(b, e)]
    hashes, stops = gram_hashes(data, 20), np.cumsum(sizes)
    assert got == [(q, q + int(np.argmin(hashes[q:q + 31]))) for b, e in zip(stops - sizes, stops, strict=True) for q in range(b, e - 49)]
    assert gram_hashes(data[7:], 20).tolist() == hashes[7:].tolist()


def test_one_row_for_each_minimizer(frame):
    """What is sorted and answered is a row for each minimizer, one position in sixteen, not one for each position."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(20_000)
    # cut differently in every text, so that the pieces are not all equal
    rows = [(i, noise(100) + "".join(passage[k:k + 90 + i] + noise(60) for k in range(0, 20_000, 200))) for i in range(8)]
    assert result(remove_repeats(frame(rows))) == brute(rows)
    runs = removed_runs(frame(rows)).collect()
    matches = [r for r in runs if r["at"] >= 0]
    assert {r["at"] for r in runs} - {WHOLE, PLACE} and matches
    removed = sum(r[2] for r in brute(rows))
    assert sum(bin(r["value"]).count("1") for r in matches) > 4 * len(matches) and len(matches) < removed / 8


def test_a_piece_at_several_places_of_one_document(frame):
    line = "the same line stands here again and again, with more than fifty bytes in it; "
    other = "".join(random.Random(6).choice("abcdefgh") for _ in range(700))
    rows = [(3, line * 40 + other + "x" + other), (2, "y" + line * 3 + other[100:400]), (1, "z" + line[5:70]), (4, other + line * 40), (-5, line[:60])]
    assert result(remove_repeats(frame(rows))) == brute(rows)

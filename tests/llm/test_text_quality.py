"""Classifier, language models, rules, licences, benchmark search and html extraction on small cases."""

from __future__ import annotations

import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagetide.llm.decontamination import contained_items
from pagetide.llm.html_extract import extract_main_text, main_text
from pagetide.llm.license_scan import KNOWN, MIT, known_digests, license_scan
from pagetide.llm.lm_scoring import PART, Scorer, log_gamma, part_levels, score_texts
from pagetide.llm.quality_classifier import SLOT_BITS, descend, fit_quality, log_count_ratios, quality_scores, unpacked
from pagetide.llm.quality_rules import quality_rules
from pagetide.llm.shared import fold_of

from .conftest import PROSE
from .test_near_dedup import brute_sets


def texts_of_two_kinds(n, seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choice(["an", "to", "re", "li", "so"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(25, 80))]
        good = i % 4 != 0
        rows.append((i, " ".join(words) if good else " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in words), int(good)))
    return rows


def test_classifier_on_held_out_rows(frame, spark, odd, empty):
    rows = texts_of_two_kinds(300)
    docs = frame([r[:2] for r in rows])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    model = fit_quality(docs, labels, learn=fold_of(F.col("doc_id")) != 0)
    got = {r["doc_id"]: r for r in quality_scores(docs, model).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == q for i, q in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["component"] == "x" for r in got.values())
    assert quality_scores(frame(odd), model).count() == len(odd) and quality_scores(empty, model).count() == 0
    none = fit_quality(docs, labels.filter("false"), learn=F.lit(True))
    assert {r["score"] for r in quality_scores(docs, none).collect()} == {0.5}


def test_word_model_and_tree_model(frame, odd, empty):
    rows = [(i, t) for i, t, _ in texts_of_two_kinds(120, 9)] + [(500, None), (501, "Unseen TO words"), (501, "to to to"), (None, "an")]
    learn = fold_of(F.col("doc_id")) != 1
    got = score_texts(frame(rows), learn, depth=3, dictionary=50).collect()
    tokens = lambda t: (t or "").lower().encode().split() + [b""]
    counts = collections.Counter(w for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter((i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[500]["score"] == 0 and by_id[500]["bits_per_byte"] is None
    assert by_id[4]["score"] < 0 and by_id[5]["bits_per_byte"] < 3
    assert score_texts(empty, learn).count() == 0


def tree_brute(data, text, depth):
    """log10 probability of `text` by weighting the trees over `data`, written as the recursion."""
    nodes = collections.defaultdict(lambda: [0, 0])

    def bits(t):
        t = bytes(depth) + t
        for i in range(depth, len(t)):
            for k in range(8):
                yield t[i - depth:i], (1 << k) | (t[i] >> (8 - k)), (t[i] >> (7 - k)) & 1

    for d in data:
        for context, known, bit in bits(d):
            for e in range(depth + 1):
                nodes[(context[depth - e:], known)][bit] += 1
    below = collections.defaultdict(list)
    for context, known in nodes:
        if context:
            below[(context[1:], known)].append((context, known))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        own = kt(*nodes[node])
        if len(node[0]) == depth:
            return own
        rest = sum(weighted(x) for x in below[node])
        top = max(own, rest)
        return top + math.log((math.exp(own - top) + math.exp(rest - top)) / 2)

    def one(node, context):
        a, b = nodes[node]
        own = (b + 0.5) / (a + b + 1)
        e = len(node[0])
        deeper = (context[depth - e - 1:], node[1]) if e < depth else None
        if deeper is None or deeper not in nodes:
            return own
        stop = math.exp(kt(a, b) - math.log(2) - weighted(node))
        return stop * own + (1 - stop) * one(deeper, context)

    total = 0.0
    for context, known, bit in bits(text):
        p = one((b"", known), context) if (b"", known) in nodes else 0.5
        total += math.log10(p if bit else 1 - p)
    return total


def test_tree_weighting_equals_the_recursion(frame):
    data = [b"abracadabra", b"a barbarian", b"cabra", b"bard"]
    docs = frame([(i, d.decode()) for i, d in enumerate(data)] + [(99, "abrasive zebra")])
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("doc_id") < 99, depth=2).collect()}
    for i, text in [*enumerate(data), (99, b"abrasive zebra")]:
        assert math.isclose(got[i], tree_brute(data, text, 2), rel_tol=1e-5)


def test_grams_outside_the_cache_are_scored_by_the_whole_trees(frame):
    data = [b"abracadabra", b"a barbarian", b"cabra", b"bard"]
    docs = frame([(i, d.decode()) for i, d in enumerate(data)] + [(99, "abrasive zebra"), (100, "")])
    for cached in (0, 9):
        got = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("doc_id") < 99, depth=4, cached=cached).collect()}
        for i, text in [*enumerate(data), (99, b"abrasive zebra"), (100, b"")]:
            assert math.isclose(got[i], tree_brute(data, text, 4), rel_tol=1e-9)


def test_contexts_seen_once_predict_in_a_large_corpus(frame):
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)) for _ in range(2)]
    rows = [(i, PROSE * 25) for i in range(500)] + [(1000, passages[0]), (1001, passages[0]), (1002, passages[1])]
    got = {r["doc_id"]: r["bits_per_byte"] for r in score_texts(frame(rows), F.col("doc_id") <= 1000).collect()}
    assert sum(len(t) for i, t in rows[:501]) > 4 << 19
    assert math.isclose(got[1000], got[1001]) and 2 * got[1001] < got[1002]


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 7.25, 1000.5, 1e9]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-11, atol=1e-11)


def test_a_part_of_the_trees_is_small_in_memory():
    """Once eight arrays of all nodes were held at a time: over 2,100 bytes a gram, 278 MB for a part."""
    grams = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 1 << 13).astype(np.uint64))
    tracemalloc.start()
    part_levels(grams, np.ones(len(grams), np.int64), 5, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1600 * len(grams) and 1600 * PART < 128 << 20


def test_scorer_cache_changes_nothing():
    keys = np.array([1, 2, 3, 6, 7], np.uint64)
    scorer = Scorer([(keys, np.full(5, 0.25, np.float32))])
    grams = np.random.default_rng(1).integers(0, 1 << 16, 4000).astype(np.uint64)
    assert np.allclose(scorer.values(grams), scorer._compute(grams)) and np.allclose(scorer.values(grams), scorer._compute(grams))


def rule_counts(text):
    words = (text or "").split()
    words = [w.decode() for w in (text or "").encode().split()]
    seen = collections.Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if seen[tuple(words[k:k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(frame, spark, odd, empty):
    kinds = texts_of_two_kinds(200, 3)
    rows = [*odd, (30, "a b c d e f g h\n" * 3 + "tail # | <x>"), (31, "p q r s t u v w p q r s t u v w p"), (32, "l\nl\n\n \nl\n l"), *((1000 + i, t) for i, t, _ in kinds)]
    trusted = spark.createDataFrame([(1000 + i,) for i, _, q in kinds if q and i % 2] + [(None,), (1001,)], "doc_id long")
    got = quality_rules(frame(rows), trusted).collect()
    counts = lambda r: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
    assert collections.Counter((r["doc_id"], counts(r)) for r in got) == collections.Counter((i, rule_counts(t)) for i, t in rows)
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[1000 + i] for i, _, q in kinds if not q)
    assert sum(kept[1000 + i] for i, _, q in kinds if q) >= 0.95 * sum(q for _, _, q in kinds)
    assert quality_rules(empty, trusted).count() == 0
    alone = quality_rules(frame(rows), trusted.filter("false")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in alone)


def test_quality_rules_count_every_trusted_document(frame, spark):
    rows = [(i, " ".join(f"w{i % 97 * k} v{i % 89}" for k in range(10))) for i in range(20_300)]
    got = quality_rules(frame(rows), spark.range(20_300).withColumnRenamed("id", "doc_id")).collect()
    assert len(got) == len(rows) and {r["llr"] for r in got} == {0.0}


def test_licences(frame, spark, odd, empty):
    known = known_digests(spark)
    changed = "Copyright (c) 2020 Someone\n\n" + MIT.upper().replace(", ", " ,  ").replace("MERCHANTABILITY", "Merchantibility")
    rows = [*odd, (20, changed), (21, "Some prose.\nreleased under the MIT Licence\nMore prose."), (22, "© 2021 X"), (23, MIT + " But not quite."), (24, KNOWN[-1][1])]
    got = {r["doc_id"]: r for r in license_scan(frame(rows), known).collect()}
    assert got[20]["license_id"] == "MIT" and got[21]["license_id"] is None and got[21]["notices"] == ["MIT"]
    assert got[22]["digest"] is None and got[23]["license_id"] is None and got[24]["license_id"] == "CC-BY-NC-4.0"
    assert got[1]["digest"] is None and got[1]["notices"] == [] and got[5]["digest"] == got[6]["digest"]
    assert license_scan(frame(odd), known).count() == len(odd) and license_scan(empty, known).count() == 0


def test_benchmark_items_in_documents(frame, spark, odd, empty):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    items = [(k, " ".join(words(rng.choice([3, 6, 14, 40, 60])))) for k in range(25)] + [(90, None), (91, ""), (None, "a b c d e f"), (92, "w1 w2")]
    docs = list(odd)
    for i in range(100, 160):
        body = words(rng.choice([10, 300, 2000]))
        item = (rng.choice(items[:25])[1]).split()
        if rng.random() < 0.4:
            item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(body))
        docs.append((i, " ".join(body[:at] + [w.upper() for w in item] + body[at:])))
    docs.append((200, items[3][1]))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_found"]) for r in contained_items(frame(docs), table).collect()}
    want = {}
    sets = {i: brute_sets(t) for i, t in items if i is not None}
    for d in {i for i, _ in docs if i is not None}:
        own = set().union(*(brute_sets(t) for i, t in docs if i == d))
        for k, s in sets.items():
            if s and 100 * len(s & own) >= 75 * len(s):
                want[(d, k)] = (len(s), len(s & own))
    assert got == want and len(want) > 30
    assert contained_items(empty, table).count() == 0 and contained_items(frame(odd), table.filter("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies.</div>
<div id="content"><h2>Head &uuml;ber &#x2019;x</h2><p>First <b>long paragraph</b> with   enough words to be the article of this page.<p>Short.
<p>Another paragraph &lt;here&gt; with a <a href="/x" title="a > b">link</a> in it and a good many words besides.<br>After a break.</div>
<div class="sidebar"><p>Popular posts and other things nobody asked for in any way at all.</p></div><form><label>Mail</label><input></form>
<section id="comments"><p>Reader: what a long and winding comment this is, longer than the article almost.</p></section><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    want = "Head über ’x First long paragraph with enough words to be the article of this page. Short. Another paragraph <here> with a link in it and a good many words besides. After a break."
    assert main_text(PAGE) == want
    marked = "<body><div>Menu words</div><article><header><h1>Title</h1></header><p>Tiny.</p><p>A paragraph of the article, with words.</p></article><p>Trailer</p></body>"
    assert main_text(marked) == "Title Tiny. A paragraph of the article, with words."
    assert main_text("") == "" and main_text("<nav>only</nav>") == "" and main_text("just text") == "just text"
    assert main_text("<p>cut off <b") .startswith("cut off") and main_text("<!-- x --><![bad[ <p>odd</p>") is not None


def test_marked_wrappers_around_the_article():
    body = "<p>A paragraph of the article, with a good many words in it.</p><p>Another paragraph of it, with as many words as the first.</p>"
    want = "A paragraph of the article, with a good many words in it. Another paragraph of it, with as many words as the first."
    noise = "<div class='share'>Share this with all of your friends today.</div>"
    for wrapper in ("div class='layout has-sidebar'", "div id='page' class='no-comments'", "section class='content social-enabled'", "form id='f'"):
        name = wrapper.split()[0]
        assert main_text(f"<body><nav>Home</nav><{wrapper}>{body}</{name}></body>") == want
        for core in ("article", "main"):
            assert main_text(f"<body><{wrapper}><{core}>{body}{noise}</{core}></{name}><div>Some words of the site at the foot of it.</div></body>") == want
    assert main_text(f"<body><article>{body}</article><div class='related'><article>{body * 3}</article></div></body>") == want
    assert main_text(f"<body><div id='content'>{body}</div><section id='comments'>{body * 3}</section></body>") == want


def test_whole_article():
    long, short = "Many words stand in the first and longer part of this text. " * 8, "Fewer words stand in the second part of it. " * 3
    parts = f"<body><ul><li><a>Home</a><li><a>News</a></ul><div><h1>Title</h1><div><p>{long}</p></div><div><p>{short}</p></div></div></body>"
    assert main_text(parts) == f"Title {long.strip()} {short.strip()}"
    two = f"<body><article><p>{long}</p><p><a>See the full report</a></p></article><article><p><a>Note</a></p><p>Tiny.</p></article></body>"
    assert main_text(two) == f"{long.strip()} See the full report Note Tiny."
    assert main_text(f"<body><div><p>{long}</p><p><a>See the full report</a></p><p>{short}</p></div></body>") == f"{long.strip()} See the full report {short.strip()}"


def test_missing_end_tags_lose_no_text():
    one, two = "A first paragraph of several words, long enough. " * 4, "Then a second one, it has as many words as that. " * 4
    want = f"{one.strip()} {two.strip()}"
    body = f"<p>{one}</p><p>{two}</p>"
    for page in (
        f"<html><head><title>T</title><body>{body}", f"<title>T</title>{body}", f"<head><meta charset=x><link rel=y>{body}",
        f"<body><a name='top'>{body}</body>", f"<body><a href='#x'>{body}</body>", f"<a href='/1'><div><a href='/2'></a>{body}</div>",
        f"<body><button>Go{body}</body>", f"<body><button>Go<button>Stop</button>{body}", f"<body><p>{one}<p>{two}",
    ):
        text = main_text(page)
        assert text.endswith(want) and "Go" not in text and "T " not in text[:3], page[:60]
    assert main_text(f"<head>{one}<p>{two}</p>") == want
    menu = "".join(f"<li><a href='/{i}'><div>Some entry {i} of the menu</div></a></li>" for i in range(6))
    assert main_text(f"<body><ul>{menu}</ul><div>{body}</div></body>") == want
    assert main_text("<a href=x><b><a href=y><i>" * 500 + one) == one.strip()


def test_broken_declarations_end_no_page():
    for declaration in ("<![x]>", "<![ foo]>", "<![>", "<![if !IE]>", "<!x>", "<![CDATA[ x ]]>"):
        assert main_text(f"<p>first words</p>{declaration}<p>second words</p>") == "first words second words"
    rng = random.Random(2)
    for _ in range(2000):
        assert main_text("".join(rng.choice(["<!", "<![", "[", "]", ">", "<", "-", "CDATA[", "x ", "doctype", "<p>", "</", "&#", "'", "="]) for _ in range(12))) is not None


def test_extract_main_text(spark):
    rows = [(1, "u", PAGE, "z"), (1, "u", PAGE, "z"), (2, None, None, "z"), (None, "v", "", "z")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")).collect()
    assert len(got) == 4 and [r["main_text"] == "" for r in got] == [False, False, True, True]
    assert extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_fitting_holds_no_second_copy_of_the_rows():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(1 << SLOT_BITS, 20_000, replace=False)).astype(np.uint32) for _ in range(300)]
    labels = np.arange(300) % 2
    ratio = log_count_ratios(rows, labels)
    tracemalloc.start()
    descend(rows, labels, ratio, 1.0, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < sum(r.nbytes for r in rows) / 2  # scaled vectors of all rows are twice the rows' size


def test_slots_as_views_of_their_column():
    column = pa.array([np.array(x, np.uint32).tobytes() for x in ([1, 2, 3], [], [9])], pa.binary())
    assert [r.tolist() for r in unpacked(column)] == [[1, 2, 3], [], [9]] and [r.tolist() for r in unpacked(column[1:])] == [[], [9]]
    assert unpacked(column[:0]) == [] and [len(r) for r in unpacked(pa.array([b""], pa.binary()))] == [0]

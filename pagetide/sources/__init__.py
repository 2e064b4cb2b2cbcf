"""Table schemas, the target dimension, versioned tables and backups."""

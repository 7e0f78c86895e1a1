"""Small tables with awkward rows, written where the queries read them (fixtures)."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

#: Columns that operators use by these names inside; they must not get in the way.
EXTRA = ["n_tokens", "ids", "found", "spans", "p", "h", "body", "node", "n", "bucket", "text_hash", "shard", "size", "slot", "row", "key", "next", "all", "run"]


def documents(rows, extra=True):
    """Table of (doc_id, text) rows with the usual columns and, if asked for, clashing ones."""
    n = len(rows)
    columns = {
        "doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
        "lang": pa.array(["en"] * n, pa.string()), "source": pa.array(["s"] * n, pa.string()),
        "n_chars": pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())}
    return pa.table(columns | ({c: pa.array([7] * n, pa.int64()) for c in EXTRA} if extra else {}))


@pytest.fixture
def sf_of(tmp_path):
    """Write tables and return their folder."""

    def write(**tables):
        base = {
            "benchmark": pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}),
            "labels": pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32())}),
            "documents": documents([])} | tables
        for name, table in base.items():
            pq.write_table(table, f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, repeated and very long texts, control characters, many scripts."""
    return [
        (0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "Two words"), (5, "A b c"), (5, "A b c"), (6, "a B  c"),
        (7, "漢字 かな ΑΣ İstanbul ﬁ ½ ² ٣ \u0085x y 😀"), (8, "x\x00y \x1c z <|endoftext|> <s> ▁▁"), (9, "don't we'll I'd, you're... 12345 !?"),
        (10, "word " * 40_000), (11, "z" * 30_000), (None, "no id"), (-3, "minus three"), (2**40, "far away"),
        (12, "aaa bbb ccc ddd eee fff ggg hhh iii jjj kkk lll"), (13, "aaa bbb ccc ddd eee fff ggg hhh iii jjj kkk lll")]

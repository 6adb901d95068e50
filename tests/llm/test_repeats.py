"""Repeated passages against brute force."""

import hashlib

import pytest

from loomline.llm import queries, repeats

from .helpers import crowded, docs, odd_rows, sentence


def brute(rows, length=50):
    """doc_id, n_bytes, spans and kept bytes of each row, from all windows."""
    last = 1 << 63
    texts = [(last if r[0] is None else r[0], (r[1] or "").encode("utf-8", "surrogatepass")) for r in rows]
    first: dict[bytes, int] = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, last + 1), i)
    out = []
    for (i, t), r in zip(texts, rows):
        gone = bytearray(len(t) + 1)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        turns = [k for k in range(len(t) + 1) if gone[k] != (gone[k - 1] if k else 0)]
        out.append((r[0], len(t), tuple(zip(turns[::2], turns[1::2])), bytes(c for c, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["n_bytes"], tuple((x["start"], x["end"]) for x in r["spans"]), bytes(r["kept"])) for r in df.collect()), key=repr)


def rows():
    passage, other = sentence(900, 30), "é" * 60 + "ß→" * 30
    out = odd_rows()
    out += [(100 + i, f"{sentence(200 + i, 20)} {passage} {sentence(300 + i, 25)}", "en", "s", 1) for i in range(30)]
    out += [(140, passage, "en", "s", 1), (141, passage + passage, "en", "s", 1), (142, passage[:49], "en", "s", 1), (143, passage[5:55], "en", "s", 1)]
    out += [(150, other, "de", "s", 1), (151, "x" + other[1:] + "y", "de", "s", 1), (152, "a" * 400, "en", "s", 1), (153, "a" * 50, "en", "s", 1), (154, "ab" * 300, "en", "s", 1), (155, "ba" * 120, "en", "s", 1)]
    edited = sentence(5, 30_000).replace("wizards", "witches")
    return out + [(160, edited, "en", "s", 1), (None, passage + "null id", "en", "s", 1), (100, sentence(901, 40) + passage, "en", "s", 1)]


def test_removes_what_smaller_ids_repeat(spark):
    want = brute(rows())
    assert any(len(s) > 1 for _, _, s, _ in want)
    assert found(repeats.dedup(crowded(docs(spark, rows())))) == want


@pytest.mark.parametrize(("length", "gram"), [(8, 3), (50, 49), (51, 24), (20, 1)])
def test_other_lengths(spark, length, gram):
    few = [r for r in rows() if len(r[1] or "") < 5000]
    assert found(repeats.dedup(docs(spark, few), length, gram, bucket_bytes=2000)) == brute(few, length)


def test_pieces_of_long_texts(spark, monkeypatch):
    big = "".join(f"{i} " for i in range(70_000))
    few = [(1, big, "en", "s", 1), (2, "no " + big[1000:300_000] + "end", "en", "s", 1)]
    assert len(big) > repeats.PIECE
    assert found(repeats.dedup(docs(spark, few))) == brute(few)


def test_no_rows(spark):
    assert repeats.dedup(docs(spark, [])).count() == 0
    assert found(repeats.dedup(docs(spark, [(3, None, None, None, None)]))) == [(3, 0, (), b"")]


def test_query_by_brute_force(spark, data):
    d = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = {(i, n, n - len(k), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(d)}
    assert {tuple(r) for r in queries.op11_prefix_doubling(spark, data).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == want
    assert any(r[2] for r in want)

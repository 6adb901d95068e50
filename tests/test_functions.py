import hashlib
import json
import re

from pyspark.sql import functions as F

from loomline.functions import checks, ids, rules, text


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_ids_equal_hashlib(spark):
    path, sha = "a/b.txt", hashlib.sha256(b"x").hexdigest()
    got = one(spark, ids.revision_id(F.lit(path), F.lit(sha)), ids.canonical(kind=F.lit("FACT"), a=F.array(F.lit("x"), F.lit("한"))), ids.web_source_id(F.lit("https://e.org")))
    assert got[0] == "sha256:" + hashlib.sha256(f"{path}\0{sha}".encode()).hexdigest()
    assert got[1] == json.dumps({"kind": "FACT", "a": ["x", "한"]}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got[2] == "web:sha256:" + hashlib.sha256(b"https://e.org").hexdigest()


def test_text(spark):
    got = one(
        spark,
        text.normalize(F.lit("é\r\nb\rc")),
        text.topic_key(F.lit("  Ａbc\n DEF ")),
        text.fold(F.lit("Straße")),
        text.protected_terms(F.lit("Do NOT use 1.2 or v3, required: 7")),
        text.shingles(F.lit("ab")),
        text.shingles(F.lit("")),
        text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))),
        text.longest_tokens(F.lit("aa bbbb ccc dddd"), 2),
        text.quantization(F.lit("Model-27B-4bit")),
        text.strip_thinking(F.lit("<think>x\ny</think> ok")),
        text.citation_base(F.lit("a/b.md / 3")),
        text.is_sensitive(F.lit("password: x")),
        text.is_sensitive(F.lit("plain words")),
        text.is_fresh(F.lit("since 2024")),
    )
    assert got == ["é\nb\nc", "abc def", "strasse", ["1.2", "7", "not", "required"], ["ab"], [], 0.5, ["bbbb", "dddd"], "4-bit", "ok", "a/b.md", True, False, True]


def test_prose_fingerprint(spark):
    long = "This is a sentence of prose that is surely longer than sixty characters [source:a.md]."
    got = one(spark, text.prose_fingerprint(F.lit(long)), text.prose_fingerprint(F.lit("- " + long)), text.prose_fingerprint(F.lit("short")))
    assert got[0] == " ".join(re.sub(r"\[source:[^\]]+\]", "", long).casefold().split()) and got[1:] == [None, None]


def test_rules(spark):
    got = one(
        spark,
        rules.safe_path(F.lit("a/../b")),
        rules.safe_path(F.lit("a//b")),
        rules.on_list(F.lit("x.example.com"), ["example.com"]),
        rules.on_list(F.lit("badexample.com"), ["example.com"]),
        rules.capacity(F.lit(16384), F.lit(1024), F.lit(4096), F.lit(512), F.lit(0.8)),
        rules.percent(30, 62, F.lit(1), F.lit(4)),
        rules.health(F.lit(16), F.lit("RUNNING")),
        rules.health(F.lit(30), F.lit("LAUNCHING")),
        rules.redacted(F.lit("user_token"), F.lit("x")),
        rules.redacted(F.lit("My_Auth_Token"), F.lit("x")),
        rules.host(F.lit("https://a.example.com:x@evil.com/")),
        rules.safe_output(F.lit("a/./b.md")),
        rules.safe_output(F.lit("a/b.MD")),
    )
    assert got == [False, True, True, False, 10752, 46, "STALE", "STARTING", "x", "[REDACTED]", "evil.com", False, True]


def test_fold_is_case_folding(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ σίσυφος", "ﬁne ﬄ", "ſharp", "İstanbul", "ŉ ǰ", "ΐ", "ABC é", "ᏸ"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(text.fold(F.col("t"))).collect()
    assert [r[0] for r in got] == [w.casefold() for w in words]


def test_checks(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "g string, o long")
    assert [r["g"] for r in checks.not_contiguous(df, "g", "o").collect()] == ["b"]
    assert checks.duplicates(df, "g").count() == 2
    assert checks.broken(df, "X", F.col("o") < 2).count() == 1

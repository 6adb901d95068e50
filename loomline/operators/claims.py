"""Claims: deterministic extraction, candidate pairs, relation merge and the ledger."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from . import graph, packing, similarity

# Merge priority of relation labels, the strongest first.
PRIORITY = ["CONFLICT", "COMPLEMENTARY", "CONTEXTUAL_REPEAT", "SEMANTIC_EQUIVALENT", "EXACT_DUPLICATE", "UNRELATED"]
FUZZY_LIMIT = 160


def sentences(docs: DataFrame, *keys: str) -> DataFrame:
    """Sentences of whole texts with their position: ends of sentence and line breaks split."""
    parts = F.split(F.regexp_replace("text", r"([.!?])[ \t]+", "$1\n"), "\n+")
    s = docs.select(*keys, F.posexplode(parts).alias("pos", "statement")).withColumn("statement", F.trim("statement"))
    return s.where("statement <> ''")


def kind(statement: Column) -> Column:
    """A claim kind by simple rules; the model port may give another."""
    s = F.lower(statement)
    return F.when(s.rlike(r"\$ |`"), "PROCEDURE").when(s.contains("warning") | s.contains("never"), "WARNING").when(s.contains("require") | s.contains("licen"), "PREREQUISITE").when(s.rlike(r"[0-9]"), "CONFIGURATION").otherwise("FACT")


def drafts(evidence: DataFrame) -> DataFrame:
    """Claim drafts of evidence rows (``evidence_id, text``)."""
    none = F.array().cast("array<string>")
    s = sentences(evidence, "evidence_id").withColumn("kind", kind(F.col("statement")))
    d = s.withColumns({"preconditions": none, "commands": none, "warnings": none})
    return d.withColumn("draft_id", ids.draft_id(F.col("evidence_id"), F.col("pos"), F.col("kind"), F.col("statement"), F.col("preconditions"), F.col("commands"), F.col("warnings")))


def content_key(kind_: Column, statement: Column, *lists: Column) -> Column:
    return ids.sha(ids.joined(kind_, text.alphanumerics(statement), *[F.array_join(x, "\u0001") for x in lists]))


def unknown_references(drafts_: DataFrame, evidence: DataFrame) -> DataFrame:
    """References to evidence that is not there (must be empty)."""
    return drafts_.select("draft_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id"), "evidence_id", "left_anti")


def token_members(claims: DataFrame, id_: str, statement: str, longest: int = 8) -> DataFrame:
    """Distinct ``id, block`` of each claim's longest tokens."""
    return claims.select(F.col(id_).alias("id"), F.explode(text.longest_tokens(F.col(statement), longest)).alias("block")).distinct()


def token_blocks(claims: DataFrame, id_: str, statement: str, longest: int = 8, most: int = FUZZY_LIMIT) -> DataFrame:
    """Inverted index over each claim's longest tokens; blocks of 2 to ``most`` claims.

    Larger blocks are left out here; ``view_pairs`` compares them in windows.
    """
    t = token_members(claims, id_, statement, longest)
    size = t.groupBy("block").agg(F.count("*").alias("members")).where((F.col("members") > 1) & (F.col("members") <= most))
    return t.join(size, "block")


def minhash_blocks(claims: DataFrame, id_: str, statement: str, most: int = FUZZY_LIMIT) -> DataFrame:
    sig = text.minhash(text.shingles(text.alphanumerics(F.col(statement))))
    m = claims.select(F.col(id_).alias("id"), F.posexplode(sig).alias("slot", "value")).where("value is not null")
    m = m.select("id", F.concat_ws(":", "slot", "value").alias("block"))
    size = m.groupBy("block").agg(F.count("*").alias("members")).where((F.col("members") > 1) & (F.col("members") <= most))
    return m.join(size, "block")


def candidate_pairs(blocks: DataFrame) -> DataFrame:
    """Distinct pairs that share a block; a block holds at most ``FUZZY_LIMIT`` claims."""
    b = blocks.select("block", F.col("id").alias("b"))
    return blocks.select("block", F.col("id").alias("a")).join(b, "block").where("a < b").select("a", "b").distinct()


def slots(sig: Column) -> Column:
    """The block names of a ``text.signature``."""
    return F.array(*[F.concat(F.lit(f"{k}:"), F.lower(F.hex(F.substring(sig, 8 * k + 1, 8)))) for k in range(8)])


def views(claims: DataFrame) -> DataFrame:
    """The five candidate views of claims ``id, path, kind, statement``: members ``id, ord`` of each ``view, block``.

    Per path in claim order, all claims by statement, each kind by statement, and the token
    and MinHash blocks by signature.  ``ord`` orders the members of a block.
    """
    c = claims.select("id", "path", "kind", text.fold(F.col("statement")).alias("folded"), text.signature(text.alphanumerics(F.col("statement"))).alias("sig"), text.longest_tokens(F.col("statement")).alias("tokens"))
    by_statement = packing.ordered(c, ["folded", "id"], "by_statement")
    c = packing.ordered(by_statement, ["sig", "folded", "id"], "by_sig").drop("folded")
    graph.forget(by_statement)
    row = lambda view, block, order: c.select(F.lit(view).alias("view"), block.alias("block"), "id", F.col(order).alias("ord"))
    whole = row("path", F.col("path").cast("string"), "id").unionByName(row("sorted", F.lit(""), "by_statement")).unionByName(row("kind", F.col("kind"), "by_statement"))
    token = c.select(F.lit("token").alias("view"), F.explode("tokens").alias("block"), "id", F.col("by_sig").alias("ord"))
    minhash = c.where(F.length("sig") > 0).select(F.lit("minhash").alias("view"), F.explode(slots(F.col("sig"))).alias("block"), "id", F.col("by_sig").alias("ord"))
    return whole.unionByName(token).unionByName(minhash)


def view_windows(members: DataFrame, most: int = FUZZY_LIMIT, number: str | None = None) -> DataFrame:
    """Rows ``view, block, window_start, id`` of what is compared: members of one window are paired.

    Token and MinHash blocks of up to ``most`` claims are one window; larger ones, and the
    other views, are windows of 40 that overlap by 8.  ``number``: a column for a window's own number.
    """
    start = "start" if number else None
    w = packing.wide_windows(members, ["view", "block"], "ord", "id", start=start)
    whole = F.col("view").isin("token", "minhash") & (F.col("n") <= most)
    w = w.where(~whole | (F.col("window_start") == F.greatest(F.lit(0), F.ceil((F.col("rn") - 39) / 32)) * 32)).withColumn("window_start", F.when(whole, F.lit(0)).otherwise(F.col("window_start")))
    numbered = [(F.col("start") + F.col("window_start")).cast(dict(w.dtypes)["start"]).alias(number)] if number else []  # the place of its first member among all
    return w.select("view", "block", "window_start", "id", *numbered)


def view_pairs(members: DataFrame, most: int = FUZZY_LIMIT, bound: int = 64) -> DataFrame:
    """Distinct pairs ``a < b`` of ``views``, by ``view_windows``.

    A pair is a row in the first of the windows that both its claims are in, and only there: each
    member has with it the numbers of its windows before, so no list of all pairs is shuffled.
    Those are at most 38 of an id that occurs once.  Pairs with an id of more than
    ``bound`` windows, which is given many times, are made distinct as rows.
    """
    windows = view_windows(members, most, "window")
    w = graph.cut(windows.where("id is not null").groupBy("id").agg(F.sort_array(F.collect_set("window")).alias("all")))
    graph.forget(windows)  # the ranked members, which no pair is made from
    each = w.select("id", "all", F.posexplode("all").alias("k", "window")).select("window", "id", F.when(F.size("all") <= bound, F.slice("all", 1, F.col("k"))).alias("before"))
    g = each.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("id", "before"))).alias("m")).where(F.size("m") > 1).select("m")
    schema = f"a {dict(members.dtypes)['id']}, b {dict(members.dtypes)['id']}"
    out = g.mapInArrow(_window_pairs(True), schema)
    if w.where(F.size("all") > bound).isEmpty():
        return out
    return out.unionByName(g.where(F.exists("m", lambda x: x["before"].isNull())).mapInArrow(_window_pairs(False), schema).distinct())


@cache
def _upper(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def _window_pairs(once: bool):
    """Pairs of windows ``m`` (members ``id, before`` by id): those in no window before, or those with a member whose ``before`` is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 200):
                rows = whole.column("m").slice(k, 200)
                flat, size = rows.flatten(), pc.list_value_length(rows).to_numpy().astype(np.int64)
                ids_, before, starts = flat.field("id"), flat.field("before"), np.cumsum(size) - size
                loose = before.is_null().to_numpy(zero_copy_only=False)
                pairs = [_upper(m) for m in size.tolist()]
                a, b = (np.concatenate([p[side] + at for p, at in zip(pairs, starts.tolist())]) for side in (0, 1))
                keep = loose[a] | loose[b]
                if once:
                    keep = ~(keep | _met(before, starts, size))
                yield pa.RecordBatch.from_arrays([ids_.take(pa.array(a[keep])), ids_.take(pa.array(b[keep]))], names=["a", "b"])

    return run


def _met(before: pa.ListArray, starts: np.ndarray, size: np.ndarray, most_pairs: int = 1 << 20) -> np.ndarray:
    """For all pairs of windows of ``size`` members, in the order of ``_upper``: whether their lists ``before`` share a number."""
    count = pc.list_value_length(before).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    member, number = np.repeat(np.arange(len(before)), count), before.flatten().to_numpy()
    window = np.repeat(np.arange(len(size)), size)[member]
    order = np.lexsort((number, window))  # members of a number stay in their order
    member, number, window = member[order], number[order], window[order]
    first = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (number[1:] != number[:-1])])) if len(order) else order
    held = np.diff(np.append(first, len(order)))
    pairs = size * (size - 1) // 2
    out, offset = np.zeros(int(pairs.sum()), bool), np.cumsum(pairs) - pairs
    for n in np.unique(held[held > 1]).tolist():
        i, j = _upper(n)
        of, step = first[held == n], max(1, most_pairs // len(i))
        for k in range(0, len(of), step):
            at, mine = of[k : k + step], window[of[k : k + step]]
            place = member[at[:, None] + np.arange(n)] - starts[mine][:, None]
            x, y = place[:, i], place[:, j]
            out[offset[mine][:, None] + x * (2 * size[mine][:, None] - x - 1) // 2 + y - x - 1] = True
    return out


def _window_scores(texts: list[str], size: np.ndarray, most_chars: int = 400_000) -> Iterator[np.ndarray]:
    """For windows of ``size`` texts each: the Jaccard coefficients of the 3-grams of all pairs, in the order of ``_upper``.

    A window is a matrix of texts by 3-grams, made in slices of 3-grams where it is large.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(size)])
    chars = np.concatenate([[0], np.cumsum(lengths)])[starts]  # before each window
    at = 0
    while at < len(size):
        end = max(at + 1, min(at + 4096, int(np.searchsorted(chars, chars[at] + most_chars, "right")) - 1))
        mine, n = slice(starts[at], starts[end]), lengths[starts[at] : starts[end]]
        x = np.frombuffer("".join(texts[mine]).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(x.max(initial=0)) + 1, np.int64)
        seen[x] = 1
        letters = np.cumsum(seen)
        bits = int(letters[-1]).bit_length()
        if end - at > 1 and 3 * bits + (end - at).bit_length() > 63:  # hardly ever: then fewer windows at once
            yield from _window_scores(texts[mine], size[at:end], most_chars // 2)
            at = end
            continue
        x = np.concatenate([letters[x], [0, 0]])
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(text)) - (np.cumsum(n) - n)[text]
        keep = np.flatnonzero(place < np.maximum(1, n[text] - 2))
        text, left = text[keep], n[text[keep]] - place[keep]
        gram = x[keep] << 2 * bits | np.where(left > 1, x[keep + 1], 0) << bits | np.where(left > 2, x[keep + 2], 0)
        window = np.repeat(np.arange(end - at), size[at:end])
        key, column = np.unique(window[text] << 3 * bits | gram, return_inverse=True)
        first = np.searchsorted(key >> 3 * bits, np.arange(end - at + 1))
        cuts = np.searchsorted(window[text], np.arange(end - at + 1))
        for k in range(end - at):
            m, own = int(size[at + k]), slice(cuts[k], cuts[k + 1])
            row, col, width = text[own] - (starts[at + k] - starts[at]), column[own] - first[k], int(first[k + 1] - first[k])
            step = max(1, (1 << 22) // m)
            shared = np.zeros((m, m))
            for low in range(0, width, step):
                here = slice(None) if width <= step else np.flatnonzero((col >= low) & (col < low + step))
                part = np.zeros((m, min(step, width - low)), np.float32)
                part[row[here], col[here] - low] = 1
                shared += part @ part.T
            sizes, (i, j) = shared.diagonal(), _upper(m)
            union = sizes[i] + sizes[j] - shared[i, j]
            yield np.where(union > 0, shared[i, j] / np.maximum(union, 1), 1.0)
        at = end


def view_scores(members: DataFrame, claims: DataFrame, id_: str, statement: str, least: float, most: int = FUZZY_LIMIT) -> DataFrame:
    """Those pairs ``a, b`` of ``view_pairs`` whose ``score`` (as of ``label_pairs``) is ``least`` or more.

    A window has its members' texts, so a pair is scored where it is met, and only what reaches
    ``least`` is made a row and shuffled.
    """
    kind_of_id = dict(members.dtypes)["id"]
    text_of = claims.select(F.col(id_).alias("id"), F.coalesce(text.alphanumerics(F.col(statement)), F.lit("")).alias("t"))
    w = view_windows(members, most).join(text_of, "id").groupBy("view", "block", "window_start").agg(F.collect_list(F.struct("id", "t")).alias("m")).where(F.size("m") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                rows = whole.column("m").slice(k, 500)
                flat = rows.flatten()
                ids_, texts = flat.field("id"), flat.field("t").to_pylist()
                number, size = ids_.to_numpy(), pc.list_value_length(rows).to_numpy()
                starts = np.cumsum(size) - size
                found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
                for start, m, score in zip(starts, size, _window_scores(texts, size)):
                    hit = np.flatnonzero(score >= least)
                    i, j = _upper(int(m))
                    for held, x in zip(found, (i[hit] + start, j[hit] + start, score[hit])):
                        held.append(x)
                a, b, score = map(np.concatenate, found)
                swap = number[a] > number[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.RecordBatch.from_arrays([ids_.take(pa.array(a)), ids_.take(pa.array(b)), pa.array(score)], names=["a", "b", "score"])

    return w.select("m").mapInArrow(run, f"a {kind_of_id}, b {kind_of_id}, score double").distinct()


def _class_windows(classes: DataFrame, of: DataFrame, most: int) -> DataFrame:
    """``start, k, cls``: the windows of ``view_windows`` that hold several classes, each with its classes.

    In all views but the paths a class is one run of ``size`` claims; a window with more than
    that run has its first or its last claim.
    """
    row = lambda d, view, block, order, size: d.select(F.lit(view).alias("view"), block.alias("block"), F.col(order).cast("long").alias("ord"), "cls", size.cast("long").alias("size"))
    many = F.col("size")
    runs = row(classes, "sorted", F.lit(""), "cls", many)
    runs = runs.unionByName(row(of.groupBy("kind", "cls").agg(F.count("*").alias("size")), "kind", F.col("kind"), "cls", many))
    runs = runs.unionByName(row(classes.withColumn("block", F.explode("tokens")), "token", F.col("block"), "by_sig", many))
    runs = runs.unionByName(row(classes.where(F.length("sig") > 0).withColumn("block", F.explode(slots(F.col("sig")))), "minhash", F.col("block"), "by_sig", many))
    runs = runs.unionByName(row(of, "path", F.col("path").cast("string"), "id", F.lit(1)))
    r = packing.run_places(runs, ["view", "block"], ["ord", "cls"], "size").where("n > size")
    last = F.col("rn") + F.col("size") - 1
    at = lambda x: F.sequence(F.greatest(F.lit(0), F.ceil((x - 39) / 32)).cast("long"), F.floor(x / 32).cast("long"))
    whole = F.col("view").isin("token", "minhash") & (F.col("n") <= most)
    return r.select("start", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.concat(at(F.col("rn")), at(last))))).alias("k"), "cls")


def _gram_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text ``t``, how many 3-grams it has, and by 256 parities (four longs) how many of them fall on each byte."""
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            b = whole.slice(k, 1000)
            texts = b.column("t").to_pylist()
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            x = np.frombuffer("".join(f"{t}\0\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            text_ = np.repeat(np.arange(len(n)), n + 2)
            place = np.arange(len(text_)) - (np.cumsum(n + 2) - n - 2)[text_]
            at = np.flatnonzero(place < np.where(n > 0, np.maximum(1, n - 2), 0)[text_])
            gram, text_ = x[at] << np.uint64(42) | x[at + 1] << np.uint64(21) | x[at + 2], text_[at]
            order = np.lexsort((gram, text_))
            gram, text_ = gram[order], text_[order]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (text_[1:] != text_[:-1])
            gram, text_ = gram[new], text_[new]
            gram = (gram ^ gram >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
            odd = np.bincount(text_ * 256 + gram.astype(np.int64), minlength=256 * len(n)) & 1
            bits = np.packbits(odd.astype(bool).reshape(-1, 256), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array(np.bincount(text_, minlength=len(n)), pa.int64()), *(pa.array(bits[:, c]) for c in range(4))], names=["cls", "n", *_BITS])


_BITS = ["b0", "b1", "b2", "b3"]


def _window_meets(least: float, most_bytes: int = 1 << 25):
    """Of windows ``m`` (``cls, n`` and sketches): pairs ``a < b`` that may have the score ``least``, once for each window.

    Parities differ in no more places than there are 3-grams that only one text has.
    """
    share = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = whole.column("m")
            flat, size = rows.flatten(), pc.list_value_length(rows).to_numpy().astype(np.int64)
            cls, n, starts = flat.field("cls").to_numpy(), flat.field("n").to_numpy(), np.cumsum(size) - size
            bits = np.ascontiguousarray(np.stack([flat.field(c).to_numpy() for c in _BITS], 1)).view(np.uint8)
            for m in np.unique(size).tolist():
                of, (i, j) = starts[size == m], _upper(m)
                step = max(1, most_bytes // (m * 1024))
                for k in range(0, len(of), step):
                    at = of[k : k + step, None] + np.arange(m)
                    signs = np.unpackbits(bits[at], axis=2).astype(np.float32) * 2 - 1
                    differ = (256 - (signs @ signs.transpose(0, 2, 1))[:, i, j]) / 2
                    x, y = n[at[:, i]], n[at[:, j]]
                    hit = (differ <= share * (x + y) + 1e-3) & (np.minimum(x, y) >= least * np.maximum(x, y))
                    x, y = cls[at[:, i]][hit], cls[at[:, j]][hit]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def linked(claims: DataFrame, least: float, most: int = FUZZY_LIMIT) -> DataFrame:
    """``node, root``: the components of claims ``id, path, kind, statement`` by the pairs of ``view_scores`` whose score, rounded, is ``least`` or more.

    No pairs are listed.  Claims of one folded statement follow each other in the view of all by statement and
    share a window with the next, so they are one class from the start, however many, and windows are
    compared by their classes: by sketches first, which lose no pair, then what is left by its texts.
    """
    folded = text.fold(F.col("statement"))
    rows = graph.cut(claims.select("id", "path", "kind", folded.alias("folded")).withColumns({"k1": F.xxhash64("folded"), "k2": F.xxhash64(F.lit(1), "folded")}))
    c = rows.groupBy("k1", "k2").agg(F.first("folded").alias("folded"), F.count("*").alias("size"), F.min("id").alias("least"))
    c = packing.ordered(c, ["folded"], "cls")
    signed = graph.cut(c.withColumns({"sig": text.signature(text.alphanumerics(F.col("folded"))), "tokens": text.longest_tokens(F.col("folded"))}))  # else a sort's sample works them out once more
    graph.forget(c)
    c = packing.ordered(signed, ["sig", "folded"], "by_sig")
    graph.forget(signed)
    of = graph.cut(rows.join(c.select("k1", "k2", "cls"), ["k1", "k2"]).select("id", "path", "kind", "cls"))
    graph.forget(rows)
    texts = c.where("folded is not null").select("cls", text.alphanumerics(F.col("folded")).alias("t"))
    sketches = texts.mapInArrow(_gram_sketches, "cls long, n long, b0 long, b1 long, b2 long, b3 long")
    w = _class_windows(c, of, most).join(sketches, "cls").groupBy("start", "k").agg(F.collect_set(F.struct("cls", "n", *_BITS)).alias("m")).where(F.size("m") > 1).select("m")
    met = graph.cut(w.mapInArrow(_window_meets(least - 1e-6), "a long, b long").distinct())
    side = lambda x: texts.select(F.col("cls").alias(x), F.col("t").alias(f"t{x}"))
    edges = met.join(side("a"), "a").join(side("b"), "b").where(F.round(text.similarity("ta", "tb"), 6) >= least).select("a", "b")
    each = of.groupBy("id").agg(F.array_sort(F.collect_set("cls")).alias("all"))  # an id given more than once is one node
    same = each.where("id is not null").where(F.size("all") > 1).select(F.col("all")[0].alias("a"), F.explode("all").alias("b"))
    to = graph.components(c.select(F.col("cls").alias("node")), graph.cut(edges.unionByName(same).distinct()))
    to = to.join(c.select(F.col("cls").alias("node"), "least", F.col("folded").isNull().alias("alone")), "node")
    to = to.select("node", "root", "alone").join(to.groupBy("root").agg(F.min("least").alias("least")), "root")
    out = each.select("id", F.col("all")[0].alias("node")).join(to, "node")
    return out.select(F.col("id").alias("node"), F.when(F.col("alone") | F.col("id").isNull(), F.col("id")).otherwise(F.col("least")).alias("root"))


def complete_pairs(claims: DataFrame, id_: str, statement: str, num: int = 7, den: int = 10) -> similarity.Similar:
    """All claims whose statements' 3-grams agree by ``num / den`` (0.7) or more, however large the blocks they share.

    The views compare large blocks in windows only; this finds every pair at the threshold, as
    classes of equal 3-gram sets and links between these.
    """
    return similarity.join(claims.select(F.col(id_).alias("id"), text.shingles(text.alphanumerics(F.col(statement))).alias("tokens")), num, den)


def reference_blocks(members: DataFrame, most: int = FUZZY_LIMIT) -> DataFrame:
    """The narrower rule for token and MinHash blocks: those above ``most`` are left out, those above 40 go in windows.

    ``members`` as of ``views``; rows ``view, block, window_start, id``.
    """
    w = packing.wide_windows(members.where(F.col("view").isin("token", "minhash")), ["view", "block"], "ord", "id").where(F.col("n") <= most)
    small = F.col("n") <= 40
    w = w.where(~small | (F.col("window_start") == 0))
    return w.where(F.least(F.lit(40), F.col("n") - F.col("window_start")) > 1).select("view", "block", "window_start", "id")


def priority(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), label).cast("long") - 1


def merge_relations(relations: DataFrame) -> DataFrame:
    """One label per unordered pair: the one of least priority number."""
    r = relations.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "relation")
    return r.groupBy("left_id", "right_id").agg(F.min_by("relation", priority(F.col("relation"))).alias("relation"), F.count("*").alias("labels"))


def label_pairs(pairs: DataFrame, claims: DataFrame, id_: str, statement: str) -> DataFrame:
    """Deterministic labels of candidate pairs: equal text, similar text, else unrelated."""
    c = claims.select(F.col(id_).alias("id"), text.alphanumerics(F.col(statement)).alias("t"), text.protected_terms(F.col(statement)).alias("p"))
    j = pairs.join(c.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.col("p").alias("pa")), "a").join(c.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("p").alias("pb")), "b")
    j = j.withColumn("score", text.similarity("ta", "tb"))
    label = F.when(F.col("ta") == F.col("tb"), "EXACT_DUPLICATE").when((F.col("score") >= 0.3) & (F.col("pa") == F.col("pb")), "SEMANTIC_EQUIVALENT").when((F.col("score") >= 0.3), "CONFLICT").otherwise("UNRELATED")
    return j.select("a", "b", "score", label.alias("relation"))


def collapsible(label: Column, same_meta: Column, same_text: Column, same_terms: Column, has_meta: Column, score: Column) -> Column:
    """Whether a relation merges two drafts into one claim."""
    exact = (label == "EXACT_DUPLICATE") & same_text
    semantic = (label == "SEMANTIC_EQUIVALENT") & same_terms & (has_meta | (score >= 0.3))
    return same_meta & (exact | semantic)


def ledger(drafts_: DataFrame, links: DataFrame) -> DataFrame:
    """Claims from drafts (``draft_id, kind, statement, evidence_ids`` and three lists) and merging links ``a, b``.

    Drafts of equal content always merge.  The representative has the longest trimmed
    statement, then the least content key, then the least draft id.
    """
    lists = ("preconditions", "commands", "warnings")
    body = F.struct("kind", F.trim("statement").alias("statement"), *lists)
    rank = F.struct((-F.length(F.trim("statement"))).alias("n"), F.col("key").alias("key"), F.col("draft_id").alias("draft_id"))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    d = drafts_.withColumn("key", content_key(F.col("kind"), F.col("statement"), *[F.col(x) for x in lists]))
    c = d.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), body.alias("r"))).alias("best"), united("evidence_ids").alias("evidence_ids"), F.array_sort(F.collect_list("draft_id")).alias("draft_ids"))
    c = c.withColumn("root", F.col("draft_ids")[0])
    if not links.isEmpty():  # classes of equal content, not drafts, are merged
        keys = c.select("root", F.explode("draft_ids").alias("draft_id"))
        end = lambda x: keys.select(F.col("draft_id").alias(x), F.col("root").alias(f"{x}_root"))
        edges = graph.cut(links.select("a", "b").join(end("a"), "a").join(end("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        moved = graph.components(nodes, edges).select(F.col("node").alias("root"), F.col("root").alias("to"))
        c = c.join(moved, "root", "left").withColumn("root", F.coalesce("to", "root"))
        c = c.groupBy("root").agg(F.min("best").alias("best"), united("evidence_ids").alias("evidence_ids"), F.array_sort(F.flatten(F.collect_list("draft_ids"))).alias("draft_ids"))
    c = c.select("root", "best.r.*", "evidence_ids", "draft_ids")
    return c.withColumn("claim_id", ids.claim_id(F.col("kind"), F.col("statement"), F.col("evidence_ids"), *[F.col(x) for x in lists]))


def inconsistent_relations(relations: DataFrame, roots: DataFrame) -> DataFrame:
    """Relations other than duplicates whose two ends were merged (an error)."""
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    j = relations.join(side("left_id"), "left_id").join(side("right_id"), "right_id")
    return j.where((F.col("left_id_root") == F.col("right_id_root")) & ~F.col("relation").isin("EXACT_DUPLICATE", "SEMANTIC_EQUIVALENT"))


MEANINGFUL = [p for p in PRIORITY if p != "UNRELATED"]


def relation_errors(relations: DataFrame, drafts_: DataFrame) -> DataFrame:
    """Relations ``left_id, right_id, relation`` that break a rule, with its name (must be empty).

    Both ends are drafts (``draft_id``), the label is meaningful, a pair comes once, and if the
    drafts have a ``side``, the ends are on different sides.
    """
    sided = "side" in drafts_.columns
    d = drafts_.select("draft_id", (F.col("side") if sided else F.lit(None).cast("string")).alias("side"))
    at = lambda c: d.select(F.col("draft_id").alias(f"{c}_id"), F.col("side").alias(f"{c}_side"), F.lit(True).alias(f"{c}_known"))
    pair = [F.least("left_id", "right_id").alias("x"), F.greatest("left_id", "right_id").alias("y")]
    n = relations.groupBy(*pair).agg(F.count("*").alias("n"))
    j = relations.withColumns({"x": pair[0], "y": pair[1]}).join(n, ["x", "y"]).join(at("left"), "left_id", "left").join(at("right"), "right_id", "left")
    code = (
        F.when(F.col("left_known").isNull() | F.col("right_known").isNull(), "UNKNOWN_REFERENCE")
        .when(~F.coalesce(F.col("relation").isin(MEANINGFUL), F.lit(False)), "NOT_MEANINGFUL")
        .when(F.col("n") > 1, "DUPLICATE_PAIR")
        .when(F.col("left_side") == F.col("right_side"), "OUTSIDE_PARTITION")
    )
    return j.withColumn("violation_code", code).where("violation_code is not null").select("left_id", "right_id", "relation", "violation_code")


def halves(members: DataFrame, batch: list[str], order: str) -> DataFrame:
    """Members of batches with their ``side``: the first half (rounded down) is LEFT.  A batch holds a bounded number."""
    from pyspark.sql import Window

    w = Window.partitionBy(*batch)
    return members.withColumn("side", F.when(F.row_number().over(w.orderBy(order)) <= F.floor(F.count("*").over(w) / 2), "LEFT").otherwise("RIGHT"))


def split_pairs(members: DataFrame, batch: list[str], item: str) -> DataFrame:
    """What a batch that was split compares: pairs inside each half, and those across (``part``: LEFT, RIGHT or CROSS)."""
    h = halves(members.select(*batch, item), batch, item)
    other = h.select(*batch, F.col(item).alias("b"), F.col("side").alias("b_side"))
    j = h.withColumnRenamed(item, "a").join(other, batch)
    inside = j.where((F.col("side") == F.col("b_side")) & (F.col("a") < F.col("b"))).select(*batch, "a", "b", F.col("side").alias("part"))
    across = j.where((F.col("side") == "LEFT") & (F.col("b_side") == "RIGHT")).select(*batch, "a", "b", F.lit("CROSS").alias("part"))
    return inside.unionByName(across)


def draft_paths(drafts_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Sorted source paths of each draft's evidence."""
    e = drafts_.select("draft_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", "relative_path"), "evidence_id")
    return e.groupBy("draft_id").agg(F.array_sort(F.collect_set("relative_path")).alias("paths"))


def reviewed_evidence(ledger_: DataFrame) -> DataFrame:
    """Distinct evidence of all claims."""
    return ledger_.select(F.explode("evidence_ids").alias("evidence_id")).distinct()

"""Benchmark decontamination by winnowing, in DataFrame functions only.

Both sides keep the least k-gram hash of every w consecutive ones (k + w - 1 = 13), so a shared run of 13 words has a
shared fingerprint. Document and benchmark fingerprints meet in a join; each hit carries the words around it and is
extended left and right to the run of equal words. An item of fewer than 13 words is one window: its whole word sequence
is looked for at every place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm import scratch

#: Words of a window, and of a hashed gram.
WINDOW = 13
GRAM = 6
#: Benchmark bytes up to which fingerprints are broadcast; beyond it both sides are shuffled by fingerprint.
BROADCAST_BYTES = 8_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words: ASCII without digits and letters (A-Z are lower-cased before).
SEPARATORS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str = "text") -> str:
    """SQL for the words of a text; none for null."""
    plain = f"if(octet_length({text}) = char_length({text}), lower({text}), translate({text}, '{_UPPER}', '{_LOWER}'))"
    return f"array_remove(coalesce(split({plain}, '{SEPARATORS}'), array()), '')"


def fingerprints(array: str, size: str, window: int = WINDOW, gram: int = GRAM) -> str:
    """SQL for the winnowed grams of a word array: longs with the hash in the upper 33 bits, the place from 0 below.

    In each window the least such long is kept, the first of equal hashes on either side.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram has at least one word and at most a window's")
    steps: list[tuple[str, str]] = [("h1", f"transform({array}, x -> xxhash64(x))")]
    # hashes and minima of longer runs are made of those of shorter ones, a whole array at a time
    join = lambda a, b, by, how: f"zip_with({a}, slice({b}, {by + 1}, {size}), (x, y) -> {how})"
    while (n := 2 ** len(steps)) <= gram:
        steps.append((f"h{n}", join(f"h{n // 2}", f"h{n // 2}", n // 2, "xxhash64(x, y)")))
    n = 2 ** (len(steps) - 1)
    hashed = f"h{n}"
    while n < gram:
        more = 1 << (gram - n).bit_length() - 1
        hashed, n = join(hashed, f"h{more}", n, "xxhash64(x, y)"), n + more
    steps.append(("m1", f"slice(transform({hashed}, (x, i) -> (x & {-(2**31)}L) | i), 1, {size} - {gram - 1})"))
    width, n = window - gram + 1, 1
    while 2 * n <= width:
        steps.append((f"m{2 * n}", join(f"m{n}", f"m{n}", n, "least(x, y)")))
        n *= 2
    least = join(f"m{n}", f"m{n}", width - n, "least(x, y)") if n < width else f"m{n}"
    inner = f"array_distinct(slice({least}, 1, {size} - {window - 1}))"
    for name, value in reversed(steps):
        inner = f"transform(array({value}), {name} -> {inner})[0]"
    return f"if({size} >= {window}, {inner}, cast(array() as array<bigint>))"


def _items(benchmark: DataFrame) -> DataFrame:
    """Word sequences that items have: words, n, and a class id, the least of the item_ids that have it."""
    parts = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.expr(words()).alias("words")).where("size(words) > 0")
    return parts.groupBy("words").agg(F.min("item").alias("sequence"), F.sort_array(F.collect_set("item")).alias("items")).withColumn("n", F.size("words"))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """decontaminate() with row, the xxhash64 of the text: it tells rows that share a doc_id apart."""
    spark = docs.sparkSession
    items = scratch.stored(_items(benchmark), "items")
    weight, lengths = items.agg(F.sum(F.expr("aggregate(words, 0L, (a, x) -> a + octet_length(x) + 1)")), F.collect_set(F.expr(f"if(n < {window}, n, null)"))).first()
    small = (weight or 0) <= BROADCAST_BYTES
    left, right = window - gram, window  # words before and from a gram on that a window may have
    context = f"slice(w, greatest(p - {left}, 0) + 1, p - greatest(p - {left}, 0) + {right})"

    def entries(frame: DataFrame, keep: list[str]) -> DataFrame:
        """key, at (the gram's place), before (words of context left of it) and context, for each fingerprint."""
        place = f"cast(f & {2**31 - 1}L as int)"
        found = f"transform({fingerprints('w', 'n', window, gram)}, f -> transform(array({place}), p -> struct(shiftright(f, 31) as key, p as at, p - greatest(p - {left}, 0) as before, {context} as context))[0])"
        for n in sorted(lengths):  # at most window - 1 of them
            short = f"transform(if(n >= {n}, sequence(0, n - {n}), cast(array() as array<int>)), p -> struct(xxhash64({n}, slice(w, p + 1, {n})) as key, p as at, -{n} as before, slice(w, p + 1, {n}) as context))"
            short = short if keep[0] == "doc_id" else f"if(n = {n}, {short}, cast(array() as array<struct<key: bigint, at: int, before: int, context: array<string>>>))"
            found = f"concat({found}, {short})"
        if keep[0] == "doc_id":  # a row for the document itself, with a key of its own
            found = f"concat({found}, array(struct(xxhash64('document', doc_id, row) as key, -1 as at, 0 as before, cast(array() as array<string>) as context)))"
        return frame.select(*keep, "n", F.expr(f"explode({found})").alias("f")).select(*keep, "n", "f.*")

    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), F.expr(words()).alias("w")).withColumn("n", F.size("w"))
    ours = entries(texts, ["doc_id", "row"])
    theirs = entries(items.withColumnRenamed("words", "w"), ["sequence"]).select("key", "sequence", F.col("before").alias("their_before"), F.col("context").alias("their_context"))
    met = ours.join(F.broadcast(theirs) if small else theirs, "key", "left").where("at < 0 or sequence is not null")
    # equal words left of the gram and from it on
    step = "get(context, before {0}) <=> get(their_context, their_before {0}) and get(context, before {0}) is not null"
    run = lambda sign, n: "aggregate(sequence({a}, {b}), struct(true as on, 0 as k), (s, j) -> if(s.on and {c}, struct(true as on, s.k + 1 as k), struct(false as on, s.k as k)), s -> s.k)".format(a=1 if sign == "-" else 0, b=n if sign == "-" else n - 1, c=step.format(f"{sign} j"))
    a = f"case when at < 0 then 0 when before < 0 then at else at - {run('-', left)} end"
    b = f"case when at < 0 then 0 when before < 0 then at - before else at + {run('+', right)} end"
    same = "(before = their_before and before < 0 and context = their_context)"
    hits = met.select("doc_id", "row", "n", "at", "sequence", F.expr(f"if(before < 0 and not ({same}), 0, {a})").alias("a"), F.expr(f"if(before < 0 and not ({same}), 0, {b})").alias("b"), "before")
    hits = hits.where(f"at < 0 or (before < 0 and b > a) or (before >= 0 and b - a >= {window})").select("doc_id", "row", "n", "at", "sequence", "a", "b")
    copies = F.count_if(F.col("at") < 0).alias("copies")  # the document's own entry, once for each of its rows
    spans = hits.groupBy("doc_id", "row", "n").agg(copies, F.collect_set(F.when(F.col("at") >= 0, F.struct("a", "b"))).alias("spans"), F.collect_set("sequence").alias("sequences"))
    covered = "aggregate(array_sort(spans), struct(0L as hit, 0 as done), (s, x) -> struct(s.hit + greatest(x.b - greatest(x.a, s.done), 0) as hit, greatest(s.done, x.b) as done), s -> s.hit)"
    counted = spans.select("doc_id", "row", "copies", F.col("n").cast("long").alias("n_words"), F.expr(covered).alias("n_hit"), "sequences")
    clean = counted.where("size(sequences) = 0").select("doc_id", "row", "copies", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    members = items.select("sequence", "items")
    hit = counted.where("size(sequences) > 0").select("doc_id", "row", "copies", "n_words", "n_hit", F.explode("sequences").alias("sequence"))
    hit = hit.join(F.broadcast(members) if small else members, "sequence").groupBy("doc_id", "row", "copies", "n_words", "n_hit").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"))
    hit = hit.select("doc_id", "row", "copies", "n_words", "n_hit", F.size("i").cast("long").alias("n_items"), F.sha2(F.array_join("i", ","), 256).alias("items_sha256"))
    out = clean.unionByName(hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    return out.withColumn("copies", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, for documents with a doc_id.

    docs: doc_id, text; benchmark: item_id, text. A row per row of docs, also where rows repeat a doc_id or are wholly equal.
    Null texts have no words. Items with the same words count each, rows with the same item_id once. An empty benchmark hits
    nothing.
    """
    return judged(docs, benchmark, window, gram).drop("row")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` against all `benchmark` items, windows of 13 words. Nulls, repeats and empty tables as in decontaminate()."""
    return decontaminate(scratch.table(spark, sf_dir, "documents"), scratch.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[k:k + least(len(w), 13) - 1], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0),
p AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM v) AS l, unnest(range(1, len(w) - n + 2)) AS t(k)),
h AS (SELECT doc_id, k, n, item FROM p JOIN v USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM h, unnest(range(k, k + n)) AS t(x) GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

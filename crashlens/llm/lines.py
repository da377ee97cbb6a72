"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words; lines that are alike in lower case are one class, known by their MD5. Lines of the same
words in another order are classes of their own, and match like others; only very short ones, which have no index, go by their sorted words. Words
are ordered by rarity: the counts of their hash classes over all lines. Two classes that are similar enough share a
word among the first n - ceil(t n) + 1 of the larger and the first n - ceil(2t / (1 + t) n) + 1 of the smaller. Classes are indexed by
those words; sizes, places and a parity of the words, of 64 bits or 128 for long lines, bound what two can have in common, and pairs that
pass are verified on the words themselves. The later line goes. Texts are read for their lines, which are written, and for what is left;
only a class's first line gets a set of words. Distinct words are told by 64 bits of their hashes, of which 55 are kept.

Only whether an earlier match exists matters. So the first class of each word's list stands for those of the list that may be
similar to it: these aren't paired with each other, unless no match for them is found elsewhere.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashlens.llm import scratch

#: Counters of the words' hash classes.
COUNTERS = 1 << 16
#: SQL: lower-cased text in which the blanks from tab to carriage return, but line breaks, are spaces; a line's distinct words.
PLAIN = r"lower(if(text rlike '[\\t\\x0B-\\r]', regexp_replace(text, '[\\t\\x0B-\\r]', ' '), text))"
WORDS = "array_distinct(array_remove(split(line, ' '), ''))"
#: SQL: the 64-bit hashes of a line's distinct words.
HASHES = "array_remove(array_distinct(transform(split(line, ' '), w -> xxhash64(w))), xxhash64(''))"
#: Bits of a word's hash in its token; the rank is above them.
BITS = 55
#: Lines of more words have a second parity.
SHORT = 64


def word_ranks(lines: DataFrame) -> list[int]:
    """By hash class of words, four times the binary logarithm of its count over all lines."""
    found = lines.select(F.explode(F.split("line", " ")).alias("w")).select(F.expr(f"cast(xxhash64(w) & {COUNTERS - 1} as int) as c")).groupBy("c").count()
    ranks = [0] * COUNTERS
    for c, n in found.collect():  # at most COUNTERS rows
        ranks[c] = int(4 * math.log2(n)) + 1
    return ranks


def _tokens(ranks: list[int]) -> str:
    """SQL for a line's words as ascending longs, rarest first: the rank above bits of the hash."""
    # a folded constant, looked up by place; never null, so that the longs are sorted as such
    table = f"cast(split('{','.join(map(str, ranks))}', ',') as array<bigint>)"
    return f"sort_array(transform(words, w -> shiftleft(coalesce(get({table}, cast(w & {COUNTERS - 1} as int)), 0L), {BITS}) | w & {(1 << BITS) - 1}))"


#: SQL: the xor of one of 64 bits for each word, by its last six, and that of those words whose seventh is set.
PARITY = "aggregate(words, 0L, (a, w) -> a ^ shiftleft(1L, cast(w & 63 as int)))"
HALF = f"if(n > {SHORT}, aggregate(words, 0L, (a, w) -> a ^ shiftleft(shiftright(w, 6) & 1, cast(w & 63 as int))), 0L)"


def _rows(docs: DataFrame) -> DataFrame:
    """A row's identity is its doc_id with a hash of its text."""
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")


def _held(pairs: DataFrame, classes: DataFrame, lines: DataFrame) -> DataFrame:
    """id and words of the classes of pairs (a, b) of class ids."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(classes.select("id", "at"), "id")
    return scratch.stored(lines.select("at", "line").join(wanted.hint("shuffle_hash"), "at").select("id", F.expr(WORDS).alias("words")), "held")


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """id of the classes that an earlier one matches, of pairs (a, b) of class ids whose words are held."""
    a, b = (held.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words")) for x in "ab")
    # the words in common stand here once, as they are found anew wherever they stand
    alike = f"{100 + percent} * size(array_intersect(a_words, b_words)) >= {percent} * (size(a_words) + size(b_words))"
    return scratch.stored(pairs.join(b, "b").join(a, "a").where(alike).select(F.col("a").alias("id")).distinct(), "matched")


def similar_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, row, gone: the numbers, from 0, of each row's lines that an earlier line matches; row is the xxhash64 of its text.

    Earlier: in a smaller doc_id, in a row of the same doc_id with a smaller hash, or before it in the same row. Match:
    100 * words in common >= percent * words of either, on the input's lines, whether or not the earlier one goes itself.
    Lines without words match nothing. Rows without doc_id or text have no lines; rows that are wholly equal are one.
    """
    least = lambda share: f"cast(ceil({share}) as int)"
    # with fewer words only equal sets match
    small = -(-percent // (100 - percent)) if percent < 100 else 1 << 30
    lines = _rows(docs).select("doc_id", "row", F.expr(f"posexplode(split({PLAIN}, '\\n')) as (number, line)")).where("trim(line) <> ''")
    lines = scratch.stored(lines.select("doc_id", "row", "number", F.monotonically_increasing_id().alias("at"), F.expr("unhex(md5(line))").alias("key"), "line"), "lines", "zstd")
    first = lines.groupBy("key").agg(F.min(F.struct("doc_id", "row", "number", "at")).alias("f")).select("key", "f.*")
    # ids follow the order of the lines
    classes = scratch.stored(first.orderBy("doc_id", "row", "number").withColumn("id", F.monotonically_increasing_id()), "classes")

    # a class's words are those of its first line; the ids that a task looks up are small beside the lines, which needn't be sorted
    sets = lines.select("at", "line").join(classes.select("at", "id").hint("shuffle_hash"), "at").select("id", "line", F.expr(HASHES).alias("words")).withColumn("n", F.size("words"))
    sets = sets.select("id", "n", F.expr(PARITY).alias("p"), F.expr(HALF).alias("q"), F.expr(f"if(n < {small}, md5(array_join(sort_array({WORDS}), ' ')), null)").alias("same"), F.expr(_tokens(word_ranks(lines))).alias("tokens"))
    prefix = f"if(n < {small}, cast(array() as array<bigint>), slice(tokens, 1, n - {least(f'n * {percent} / 100D')} + 1))"
    sets = scratch.stored(sets.select("id", "n", "p", "q", "same", F.expr(prefix).alias("prefix")), "sets")
    # none is null; said here so that both sides of the join below have the same filters, and share the exchange
    index = sets.where("size(prefix) > 0 and id is not null and n is not null and p is not null and q is not null").select("id", "n", "p", "q", F.posexplode("prefix").alias("place", "token")).where("token is not null").repartition("token")

    def fits(a: str, b: str) -> str:
        """Sizes, and places of the word in common, and the bits that differ, at most as many as words, leave room for a match."""
        sizes = f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
        places = f"{100 + percent} * (least({a}.place, {b}.place) + least({a}.n - {a}.place, {b}.n - {b}.place)) >= {percent} * ({a}.n + {b}.n)"
        both = f"bit_count({a}.q ^ {b}.q) + bit_count({a}.p ^ {a}.q ^ {b}.p ^ {b}.q)"
        bits = f"{100 + percent} * ({a}.n + {b}.n - if({a}.n > {SHORT} and {b}.n > {SHORT}, {both}, bit_count({a}.p ^ {b}.p))) >= {2 * percent} * ({a}.n + {b}.n)"
        return f"{sizes} and {places} and {bits}"

    few = lambda x: f"{x}.place < {x}.n - {least(f'{x}.n * {2 * percent} / {100 + percent}D')} + 1"
    smaller = lambda a, b: f"if({a}.n < {b}.n or {a}.n = {b}.n and {a}.id < {b}.id, {few(a)}, {few(b)})"
    heads = Window.partitionBy("token").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = index.withColumn("head", F.first(F.struct("id", "n", "place", "p", "q")).over(heads))
    far = listed.withColumn("top", F.expr("head.id = id")).where(f"top or not ({re.sub(r'\bx[.]', '', fits('x', 'head'))})").drop("head")
    # pairs with a class that isn't near to the first of the list; both orders, as the other one may be near. All that are near have a pair with the first
    met = far.alias("a").join(index.alias("b"), F.expr(f"a.token = b.token and a.id <> b.id and {fits('a', 'b')} and (a.top or {smaller('a', 'b')})"))
    met = met.selectExpr("greatest(a.id, b.id) as a", "least(a.id, b.id) as b")
    pairs = scratch.stored(met.distinct(), "pairs")
    held = _held(pairs, classes, lines)
    gone = _verified(pairs, held, percent)
    # a class that is near to a list's first one is the later one of a pair
    later = index.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    rest = later.join(gone, "id", "left_anti").alias("a").join(later.alias("b"), F.expr(f"a.token = b.token and b.id < a.id and {fits('a', 'b')}")).selectExpr("a.id as a", "b.id as b").distinct()
    rest = scratch.stored(rest.join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        # both are later ones of pairs, whose words are held already
        gone = gone.unionByName(_verified(rest, held, percent))
    # short lines of the same words
    short = sets.where("same is not null").select("id", "same")
    gone = gone.unionByName(short.join(short.groupBy("same").agg(F.min("id").alias("first")), "same").where("id <> first").select("id"))
    scratch.forget(pairs, rest, held)

    stays = classes.join(gone, "id", "left_anti").groupBy("doc_id", "row").agg(F.collect_set("number").alias("stays"))
    out = lines.groupBy("doc_id", "row").agg(F.collect_set("number").alias("all")).join(stays, ["doc_id", "row"], "left")
    out = out.select("doc_id", "row", F.expr("sort_array(array_except(all, coalesce(stays, cast(array() as array<int>))))").alias("gone"))
    return out.where("size(gone) > 0")


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every row of docs with its text's remaining lines, n_lines and n_removed, which replace columns of these names.

    Null texts stay null with no lines, an empty one has one line; texts may be of any length. Rows without doc_id stay as they are.
    Rows that are wholly equal in doc_id and text keep the same lines. No rows give no rows.
    """
    mark = "_gone"
    while mark in map(str.lower, docs.columns):
        mark = f"_{mark}"
    gone = similar_lines(docs, percent).select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), F.col("gone").alias("_gone"))
    match = (docs["doc_id"].cast("long") == gone["_doc"]) & (F.xxhash64(docs["text"]) == gone["_row"])
    joined = docs.join(gone, match, "left").select(*(docs[f"`{c}`"] for c in docs.columns), gone["_gone"].alias(mark))
    kept = F.expr(f"array_join(filter(split(text, '\\n'), (x, i) -> not array_contains({mark}, i)), '\\n')")
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"),
        "n_removed": F.coalesce(F.size(mark), F.lit(0)).cast("long"),
        "text": F.when(F.col(mark).isNull(), F.col("text")).otherwise(kept),
    }).drop(mark)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256: of the text's remaining lines, joined by line breaks (null text: empty)."""
    out = dedup_lines(scratch.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, i, list_distinct(list_filter(string_split_regex(lower(string_split(text, chr(10))[i]), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS t
           FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i) WHERE doc_id IS NOT NULL AND text IS NOT NULL),
k AS (SELECT doc_id, i, list_sort(t) AS t FROM l WHERE len(t) > 0),
s AS (SELECT t, len(t) AS n, min((doc_id, i)) AS f, row_number() OVER () AS id FROM k GROUP BY t),
w AS (SELECT id, n, f, unnest(t) AS x FROM s),
d AS (SELECT x, count(*) AS df FROM w GROUP BY x),
p AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY id ORDER BY df, w.x) AS r FROM w JOIN d USING (x)) WHERE r <= n - CAST(ceil(n * 80 / 100.0) AS BIGINT) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b USING (x) WHERE b.f < a.f AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT c.a AS id FROM c JOIN s y ON y.id = c.a JOIN s z ON z.id = c.b
      WHERE 100 * len(list_intersect(y.t, z.t)) >= 80 * (y.n + z.n - len(list_intersect(y.t, z.t)))),
o AS (SELECT k.doc_id, list(k.i) AS gone FROM k JOIN s USING (t) LEFT JOIN g USING (id) WHERE g.id IS NOT NULL OR s.f < (k.doc_id, k.i) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT coalesce(list_contains(gone, i), false)), chr(10)), '')) AS kept_sha256
FROM documents d LEFT JOIN o USING (doc_id)
"""

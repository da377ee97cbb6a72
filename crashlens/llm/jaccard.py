"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are its distinct word shingles. Documents with equal sets are one node. Tokens are ordered by how many
nodes hold them, rarest first; two nodes that are similar enough share at least two tokens among the first
n - ceil(t n) + 2 of either. A rare token is indexed alone; tokens that many prefixes hold are indexed in pairs. Tokens of
one node only take up places of a prefix and are never sent on, and a node whose prefix has no others can't link.

Before lists are searched for pairs, each list's members are held against one pivot, and what that links is joined. Lists
of the same members count once. In a list a node meets the larger components as wholes, a row each: bounds over a component's members
say whether one may link. Only then, once for a node and a component however many tokens they share, pairs with the members are made, and
only where sizes and a 256-bit parity of the tokens leave room. They are verified on hashes of shingles, and what passes on
the shingles' words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashlens.llm import scan, scratch
from crashlens.llm.components import components

U64 = np.uint64
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Bits of a token that are kept; the rest of its hash is dropped.
TOKEN_BITS = 48
#: Tokens sorted and dealt out at a time by a map task.
FLUSH = 1 << 20
#: Tokens of a bucket, about.
BUCKET = 1 << 20
#: Tokens of a narrow range of hashes from which on they aren't counted in one place, but all taken as frequent, and the ranges.
HOT = 1 << 20
RANGE_BITS = 14
#: Ids up to which a join with the texts is broadcast: three longs each.
BROADCAST_ROWS = 200_000
#: First hashes that different sets may share; such sets go by their second hash.
MOST_TWICE = 100_000
#: Longest list of prefixes that a single token's index keeps; tokens with longer ones are indexed in pairs.
RARE = 32


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, and n + 1 offsets. Fewer words than k make one shingle."""
    data, offsets = scan.buffers(column)
    starts, ends, first = scan.spans(data, offsets)
    words = scan.hashes(data, starts, ends, lower=True)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = scan.grams(words, k)
    whole = np.arange(len(grams)) + k <= first[1:][doc[: len(grams)]]
    tokens, sizes = grams[whole], np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.zeros(len(short), U64)
        for i, d in enumerate(short.tolist()):
            own[i] = scan.grams(words[first[d] : first[d + 1]], int(counts[d]))[0]
        tokens = np.insert(tokens, (np.cumsum(sizes) - sizes)[short], own)
        sizes[short] = 1
    edges = np.concatenate(([0], np.cumsum(sizes)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        tokens[a:b].sort()
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    new[edges[:-1][sizes > 0]] = True
    return tokens[new], np.concatenate(([0], np.cumsum(new)))[edges]


def _prints(tokens: np.ndarray, edges: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(scan.mix(tokens, salt), dtype=U64)))
    return scan.mix(sums[edges[1:]] - sums[edges[:-1]] + np.diff(edges).astype(U64)).view(np.int64)


def _nodes(tokens: np.ndarray, edges: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """The set's name: its first hash, or the second one where different sets share the first."""
    out = _prints(tokens, edges, 1)
    if len(twice):
        shared = np.isin(out, twice)
        out[shared] = _prints(tokens, edges, 2)[shared]
    return out


def _twice(rows: DataFrame) -> np.ndarray:
    """First hashes that sets with different second ones share: of n sets about n * n / 2 ** 65."""
    own = rows.where("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a < b")
    found = own.select("node").limit(MOST_TWICE + 1).collect()
    if len(found) > MOST_TWICE:
        raise RuntimeError(f"more than {MOST_TWICE} hashes of 64 bits are shared")
    return np.array([r.node for r in found], np.int64)


def _named(rows: DataFrame, twice: np.ndarray) -> DataFrame:
    """sets() with node as _nodes() gives it."""
    if not len(twice):
        return rows
    return rows.withColumn("node", F.when(F.col("doc_id").isNotNull() & F.col("node").isin(twice.tolist()), F.col("check")).otherwise(F.col("node")))


def sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, node and check: two hashes of the set; null without words.

    Rows without doc_id hold n_shingles of a range of hashes (node) that stands out in a partition: a frequent token is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, names = np.zeros(1 << RANGE_BITS, np.int64), ["doc_id", "row", "n_shingles", "node", "check"]
        for batch in batches:
            for at, part in scan.pieces(batch.column("text"), scan.CHUNK):
                tokens, edges = shingle_sets(part, k)
                ranges += np.bincount((tokens >> U64(64 - RANGE_BITS)).astype(np.int64), minlength=len(ranges))
                n = np.diff(edges)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(part)), batch.column("row").slice(at, len(part)), pa.array(n), *(pa.array(_prints(tokens, edges, s), mask=n == 0) for s in (1, 2))], names)
        much = np.flatnonzero(ranges > 64 + 4 * ranges.mean())
        yield pa.RecordBatch.from_arrays([pa.nulls(len(much), pa.int64()), pa.nulls(len(much), pa.int64()), pa.array(ranges[much]), pa.array(much), pa.nulls(len(much), pa.int64())], names)

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, row long, n_shingles long, node long, check long")


def _deal(docs: DataFrame, k: int, buckets: int, hot: frozenset[int], twice: np.ndarray) -> DataFrame:
    """Tokens outside hot ranges with their nodes, dealt to buckets by value: sorted token steps, places in a table of nodes, that table."""
    left_out = np.array(sorted(hot), U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, nodes, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            token, owner, table = np.concatenate(held), np.concatenate(owners), np.concatenate(nodes)
            if len(left_out):
                cool = ~np.isin(token >> U64(TOKEN_BITS - RANGE_BITS), left_out)
                token, owner = token[cool], owner[cool]
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            bucket = ((token >> U64(TOKEN_BITS - 32)) * U64(buckets)) >> U64(32)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = {"bucket": [], "base": [], "steps": [], "owner": [], "nodes": []}
            for b in np.flatnonzero(np.diff(edges)).tolist():
                t = token[edges[b] : edges[b + 1]]
                steps = np.diff(t)
                own, places = np.unique(owner[edges[b] : edges[b + 1]], return_inverse=True)
                rows["bucket"].append(b)
                rows["base"].append(int(t[0]))
                rows["steps"].append((steps.astype("<u4") if not len(steps) or steps.max() < 2**32 else steps.astype("<u8")).tobytes())
                rows["owner"].append(places.astype("<u2").tobytes())
                rows["nodes"].append(table[own].tobytes())
            return pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("steps", pa.binary()), ("owner", pa.binary()), ("nodes", pa.binary())]))

        for batch in batches:
            for _, part in scan.pieces(batch.column("text"), scan.CHUNK):
                tokens, edges = shingle_sets(part, k)
                some = np.flatnonzero(np.diff(edges))
                have = sum(map(len, nodes))
                if held and (n + len(tokens) > FLUSH or have + len(some) > 65000):
                    yield flush()
                    held, owners, nodes, n, have = [], [], [], 0, 0
                for i in range(0, len(some), 65000):  # a batch of many tiny texts
                    if i:
                        yield flush()
                        held, owners, nodes, n, have = [], [], [], 0, 0
                    own = some[i : i + 65000]
                    held.append(tokens[edges[own[0]] : edges[own[-1] + 1]] >> U64(64 - TOKEN_BITS))
                    owners.append(np.repeat(np.arange(have, have + len(own), dtype=np.uint16), np.diff(edges)[own]))
                    nodes.append(_nodes(tokens, edges, twice)[own])
                    n += len(held[-1])
        if held:
            yield flush()

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "bucket int, base long, steps binary, owner binary, nodes binary")


SHARED = "node long, tokens array<long>, holders array<int>"


def _frequent(docs: DataFrame, k: int, hot: frozenset[int], twice: np.ndarray) -> DataFrame:
    """Tokens of hot ranges by node, as if all nodes held them: no list of a frequent token is ever made."""
    ranges = np.array(sorted(hot), U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in scan.pieces(batch.column("text"), scan.CHUNK):
                tokens, edges = shingle_sets(part, k)
                keep = np.isin(tokens >> U64(64 - RANGE_BITS), ranges)
                at = np.concatenate(([0], np.cumsum(keep)))[edges]
                some = np.flatnonzero(np.diff(at))
                offsets = pa.array(np.append(at[some], at[-1]).astype(np.int32))
                own = (tokens[keep] >> U64(64 - TOKEN_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_nodes(tokens, edges, twice)[some]), pa.ListArray.from_arrays(offsets, pa.array(own)), pa.ListArray.from_arrays(offsets, pa.array(np.full(len(own), 2**31 - 1, np.int32)))],
                    ["node", "tokens", "holders"],
                )

    found = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, SHARED)
    return found.groupBy("node").agg(F.min(F.struct("tokens", "holders")).alias("x")).select("node", "x.*")


def _shared(table: pa.Table) -> pa.Table:
    """A bucket's tokens that two nodes or more hold: by node, the tokens and how many hold each."""
    token, node = [], []
    for i in range(len(table)):
        row = table.slice(i, 1).to_pylist()[0]
        places = np.frombuffer(row["owner"], "<u2")
        steps = np.frombuffer(row["steps"], "<u4" if len(row["steps"]) == 4 * (len(places) - 1) else "<u8").astype(np.int64)
        token.append(np.concatenate(([row["base"]], row["base"] + np.cumsum(steps))))
        node.append(np.frombuffer(row["nodes"], np.int64)[places])
    token, node = np.concatenate(token), np.concatenate(node)
    order = np.argsort(token)
    token = token[order]
    same = token[1:] == token[:-1]
    keep = np.zeros(len(token), bool)
    keep[1:] |= same
    keep[:-1] |= same
    token, node = token[keep], node[order[keep]]
    del order, same, keep
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[new], node[new]
    _, inverse, holders = np.unique(token, return_inverse=True, return_counts=True)
    holders = holders[inverse] if len(token) else np.zeros(0, np.int64)
    token, node, holders = token[holders > 1], node[holders > 1], holders[holders > 1]
    order = np.argsort(node, kind="stable")
    token, node, holders = token[order], node[order], holders[order]
    own, at = np.unique(node, return_index=True)
    edges = pa.array(np.append(at, len(node)).astype(np.int32))
    return pa.table({"node": pa.array(own), "tokens": pa.ListArray.from_arrays(edges, pa.array(token)), "holders": pa.ListArray.from_arrays(edges, pa.array(holders.astype(np.int32)))})


def _parity(part: int) -> str:
    """SQL: of the tokens that fall to one of four parts, a bit for each, twice the same bit being none."""
    return f"aggregate(filter(tokens, t -> (shiftright(t, 6) & 3) = {part}), 0L, (s, t) -> s ^ shiftleft(1L, cast(t & 63 as int)))"


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes that are similar enough. Tokens that one node holds alone aren't in any intersection."""
    one, two = (held.select(F.col("node").alias(x), F.col("tokens").alias(f"{x}_tokens"), F.col("n").alias(f"{x}_n")) for x in "ab")
    common = pairs.join(two, "b").join(one, "a").withColumn("common", F.size(F.array_intersect("a_tokens", "b_tokens")))
    return common.where(f"100 * common >= {percent} * (a_n + b_n - common)").select("a", "b")


def _confirmed(links: DataFrame, names: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes whose texts' shingles, as words, are similar enough. names: node, least, row (a doc_id and a text's hash)."""
    wanted = scratch.stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(names, "node"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:  # else both sides are shuffled by document
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), F.xxhash64("text").alias("row"), "text").join(wanted, ["least", "row"])
    texts = scratch.stored(texts.groupBy("node").agg(F.max("text").alias("text")), "link-texts")
    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")

    def grams(text: str) -> set[tuple[str, ...]]:
        words = [x for x in re.split("[\x20\x09-\x0d]+", text.translate(_LOW)) if x]
        return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_text"), batch.column("b_text"), strict=True):
                x, y = grams(x.as_py()), grams(y.as_py())
                common = len(x & y)
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = scratch.stored(links.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long"), "links")
    scratch.forget(texts)
    return out


def _indexed(docs: DataFrame, rows: DataFrame, k: int, percent: int, twice: np.ndarray) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the nodes that may link: names (node, n, least, row: its smallest doc_id, and the hash of a text), tokens (held), and prefixes."""
    total, hot = rows.where("doc_id is not null").agg(F.sum("n_shingles")).first()[0] or 0, rows.where("doc_id is null").groupBy("node").agg(F.sum("n_shingles").alias("n"))
    hot = frozenset(r.node for r in hot.where(F.col("n") > HOT).collect())  # at most 2 ** RANGE_BITS
    buckets = max(64, total // BUCKET)
    names = rows.where("doc_id is not null and n_shingles > 0").groupBy("node", "check").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.max("n_shingles").alias("n"))
    if not names.groupBy("node").count().where("count > 1").isEmpty():
        raise RuntimeError("two sets share 128 bits of hash")
    names = names.select("node", "n", F.col("least.doc_id").alias("least"), F.col("least.row").alias("row"))
    held = _deal(docs, k, buckets, hot, twice).groupBy("bucket").applyInArrow(_shared, SHARED)
    if hot:
        held = held.unionByName(_frequent(docs, k, hot, twice))
    held = held.groupBy("node").agg(F.collect_list(F.struct("tokens", "holders")).alias("x")).select("node", F.flatten("x.tokens").alias("tokens"), F.flatten("x.holders").alias("holders"))
    held = held.join(names.select("node", "n"), "node").withColumn("alone", F.col("n") - F.size("tokens"))
    # ceil(n percent / 100) tokens of n must be common at least
    held = held.withColumn("room", F.expr(f"cast(n - (n * {percent} + 99) div 100 + 2 - alone as int)")).where("room > 0")
    held = scratch.stored(held, "held")
    order = "array_sort(transform(tokens, (t, i) -> struct(holders[i] as holders, t as token)))"
    signed = held.select("node", "tokens", "holders", "n", "alone", "room", *(F.expr(_parity(i)).alias(x) for i, x in enumerate(SIGNS)))
    prefix = signed.select("node", "n", "alone", *SIGNS, F.explode(F.expr(f"transform(slice({order}, 1, room), x -> x.token)")).alias("token"))
    return names, held, scratch.stored(prefix, "prefix")


SIGNS = ("s0", "s1", "s2", "s3")
ENTRY = ("node", "n", "alone", *SIGNS, "component", "members")


def _fits(percent: int) -> str:
    """SQL: sizes, and tokens that are in one set only (those of one node alone, and at least the parity bits that differ), leave room for a link."""
    apart = "a_alone + b_alone + " + " + ".join(f"bit_count(a_{x} ^ b_{x})" for x in SIGNS)
    return f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) and (100 + {percent}) * (a_n + b_n - ({apart})) >= {2 * percent} * (a_n + b_n)"


def _may_fit(percent: int) -> str:
    """SQL: _fits() for a node b and any member of a part of a component, of which least and most values and bits are known; for one member the same."""
    apart = "a_alone + b_alone + " + " + ".join(f"bit_count(b_{x} & ~a_or_{x}) + bit_count(a_and_{x} & ~b_{x})" for x in SIGNS)
    return f"100 * a_most >= {percent} * b_n and 100 * b_n >= {percent} * a_least and (100 + {percent}) * ({apart}) <= (100 - {percent}) * (a_most + b_n)"


def _side(x: str, names: tuple[str, ...], of: str = "") -> list:
    return [F.col(f"{of}{c}").alias(f"{x}_{c}") for c in names]


def _lists(entries: DataFrame) -> DataFrame:
    """Entries of lists with two components or more, of lists with the same members only one: token, size, entry."""
    same = [F.count(F.lit(1)).alias("size"), *(F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"x{i}") for i in (1, 2)), F.min("component").alias("least"), F.max("component").alias("most")]
    lists = entries.groupBy("token").agg(*same).where("least < most")
    return entries.join(lists.groupBy("size", "x1", "x2").agg(F.min("token").alias("token")).select("token", "size"), "token")


def _pairs(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b) of nodes of different components that have room for a link, once each: one shares two tokens of its prefix with the other or its component."""
    rare = _lists(index).where(f"size <= {RARE}")
    often = index.join(index.groupBy("token").count().where(f"count > {RARE}").select("token"), "token", "left_semi")
    often = often.groupBy(*ENTRY).agg(F.array_sort(F.collect_list("token")).alias("t"))
    often = often.select(*ENTRY, F.explode(F.expr("flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> xxhash64(x, y))))")).alias("token"))

    def meet(entries: DataFrame) -> DataFrame:
        bits = (F.expr(f"bit_{f}({x}) as a_{f}_{x}") for x in SIGNS for f in ("and", "or"))
        parts = entries.groupBy("token", F.col("component").alias("a_component")).agg(F.max("members").alias("a_members"), F.min("n").alias("a_least"), F.max("n").alias("a_most"), F.min("alone").alias("a_alone"), *bits)
        b = entries.select("token", *_side("b", ENTRY))
        return b.join(parts, "token").where(f"(b_members, b_component) < (a_members, a_component) and {_may_fit(percent)}").select(*(f"b_{c}" for c in ENTRY[:-2]), "a_component").distinct()

    met = meet(rare).unionByName(meet(_lists(often))).distinct()
    members = index.select(*_side("a", ENTRY[:-1])).distinct()
    return met.join(members, "a_component").where(_fits(percent)).select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """a, b (a < b): all links between different sets, by the smallest doc_ids that have them; rows and sets as jaccard_components.

    As many rows as there are links, so a group of near copies gives its square; the components need no such thing.
    """
    rows = scratch.stored(sets(docs, k), "sets")
    twice = _twice(rows)
    rows = _named(rows, twice)
    names, held, prefix = _indexed(docs, rows, k, percent, twice)
    found = scratch.stored(_verified(_pairs(prefix.withColumn("component", F.col("node")).withColumn("members", F.lit(1)), percent), held, percent), "links")
    links = _confirmed(found, names.select("node", "least", "row"), docs, k, percent)
    a, b = (names.select(F.col("node").alias(x), F.col("least").alias(f"{x}_id")) for x in "ab")
    return links.join(a, "a").join(b, "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """jaccard_components() with row, the xxhash64 of the text, and component, a name of the group (null: it links with nothing).

    doc_id and row tell a row of docs from others with its id; rows that are wholly equal have a row each.
    """
    rows = scratch.stored(sets(docs, k), "sets")
    twice = _twice(rows)
    rows = _named(rows, twice)
    names, held, prefix = _indexed(docs, rows, k, percent, twice)
    pivots = prefix.groupBy("token").agg(F.min(F.struct("alone", "node", "n", *SIGNS)).alias("p"), F.count(F.lit(1)).alias("size")).where("size > 1")
    own = ("n", "alone", *SIGNS)
    stars = prefix.join(pivots, "token").select(F.col("p.node").alias("a"), *_side("a", own, "p."), F.col("node").alias("b"), *_side("b", own))
    links = scratch.stored(_verified(stars.where(f"a <> b and {_fits(percent)}").select("a", "b").distinct(), held, percent), "stars")
    while True:  # once, unless hashes of different shingles are equal
        joined = components(links)
        known = joined.join(joined.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("members")), "component")
        index = scratch.stored(prefix.join(known, "node", "left").withColumns({"component": F.coalesce("component", "node"), "members": F.coalesce("members", F.lit(1))}).select("token", *ENTRY), "index")
        found = scratch.stored(links.unionByName(_verified(_pairs(index, percent), held, percent)).distinct(), "found")
        scratch.forget(index)
        links = _confirmed(found, names.select("node", "least", "row"), docs, k, percent)
        if links.count() == found.count():
            break
    joined = components(links)
    scratch.forget(prefix, held, found)

    nodes = names.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = nodes.join(ids, "component").select("node", "component_id", "component")
    rows = rows.where("doc_id is not null")
    some = rows.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id", "row", "component")
    return some.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row", F.lit(None).cast("long").alias("component")))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links lead to.

    docs: doc_id and text; other columns are ignored. A null or blank text has no shingles and links with nothing; rows
    without doc_id are left out; rows that repeat a doc_id with different texts are documents of their own, so that links of
    either lead to its id. Links: 100 * intersection >= percent * union. Equal sets are told by 128 bits of hash.
    """
    return jaccard_groups(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all `documents`, shingles of five words, 0.8 or more. Nulls, repeats and empty tables as in jaccard_components()."""
    return jaccard_components(scratch.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id
"""

"""Jaccard join of word-shingle sets with a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlens.llm.common import byte_slices, components, discard, table, text_batches, written
from barlens.llm.shingles import digest, least, shingle_sets

#: Words per shingle and similarity in percent.
K, PERCENT = 5, 80
#: Random orders that pick leaders; tokens held by a group of the matrix; most ids that are sent to every executor.
LEADERS, GROUP_TOKENS, SENT_IDS = 3, 1 << 17, 1 << 20
#: Queries that one task compares with a part of a group.
PORTION = 2048
#: Prefixes are longer than needed by a share of 1 / LESS, so that as many common tokens can be asked of them.
LESS = 10


def _common(n: int) -> int:
    """Common tokens to ask of two prefixes, for the smaller of two sets of n tokens."""
    return max(1, n // LESS)


def _prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + _common(n)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    off = np.zeros(len(sets) + 1, np.int32)
    off[1:] = np.cumsum([len(x) for x in sets])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(sets).view(np.int64)))


def _set(x) -> np.ndarray:
    """A list of tokens as the sorted array it was made from."""
    return x.values.to_numpy().view(np.uint64)


def _profile(k: int, percent: int):
    """Per text: size and digest of its set, and its prefix, the smallest values in hash order."""
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                sets = list(shingle_sets(part.column(1), k))
                d = [digest(s) for s in sets]
                heads = [s[:_prefix_size(len(s), percent)] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in d], pa.int64()),
                     pa.array([x for _, x in d], pa.int64()), _lists(heads)], names=["doc_id", "n", "h1", "h2", "prefix"])
    return profile


def _full(k: int):
    """Per text the whole set and its smallest values under some random orders."""
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, 1):
                sets = list(shingle_sets(part.column(1), k))
                out = [(*digest(s), least(s, LEADERS) if len(s) else [0] * LEADERS) for s in sets]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets), *[pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]],
                                                 names=["node", "tokens", "h1", "h2", "keys"])
    return full


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(percent: int):
    """Pairs whose whole sets reach the similarity."""
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, set_b = None, None
        for batch in batches:
            hits = []
            for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b")], batch.column("x"), batch.column("y")):
                if b != last:  # rows come sorted by b
                    last, set_b = b, _set(y)
                if _similar(_set(x), set_b, percent):
                    hits.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in (0, 1)], names=["a", "b"])
    return verified


def _opened(percent: int):
    """Queries of one group part against its members, which come once; both sides are of bounded size."""
    def opened(queries: pa.Table, members: pa.Table) -> pa.Table:
        nodes, sets, hits = members.column("node").to_pylist(), [_set(t) for t in members.column("tokens").combine_chunks()] if len(members) else [], []
        for q, x in zip(queries.column("q").to_pylist(), queries.column("x")):
            query = _set(x)
            hits += [(q, m) for m, s in zip(nodes, sets) if _similar(query, s, percent)]
        return pa.table({k: pa.array([h[i] for h in hits], pa.int64()) for i, k in enumerate("ab")})
    return opened


def similar_documents(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of (doc_id, text): documents whose shingle sets have a Jaccard similarity of
    at least ``percent`` / 100 are linked, links make components.

    1. Every text gives the size and digest of its set and a prefix in hash order, long enough that two similar sets have
       ``m`` common tokens within both prefixes.  Equal sets are one class.
    2. Tokens are counted over all prefixes.  A class goes on if at least m of its prefix tokens occur twice.
    3. The whole sets of those classes are counted in the same way.  A class goes on if at least ``percent`` of its tokens occur
       twice; its probes are the rarest of them, so many that two similar classes share a probe.  A passage that many
       documents have is a probe only where hardly anything else is left.
    4. Similar classes are partitioned into groups: classes that have the same smallest token under one of a few random
       orders are compared with the first of them, and verified links make the groups.  A group of copies of any size costs one
       comparison per member here and is never compared within itself.
    5. The token-group matrix holds the probes of each group.  A probe that only one group has is dropped, so is a pair within one
       group; the smaller of two groups asks, the larger answers.  Sizes, and the places of the probe in the order of both
       sides, bound the overlap before a pair is made.  The token union of every part of a group that is asked (parts have bounded size) is
       stored once; a query's tokens are counted in it, and only where the count reaches ``percent`` of the query are the
       members of the part fetched, once for all queries that open it (many queries are dealt in portions).
    6. All verified links go through ``components``.

    No step loses a link between components: steps 2, 3 and 5 are bounds, exact for every pair; links inside a group that step 4
    has already connected are not listed, as they change no component.  Shingles are compared as 64-bit values.

    Null, empty and blank texts have empty sets and are linked with nothing; texts with fewer than k words have one token,
    the whole sequence; repeated rows are linked if not empty; a null doc_id is returned as its own row, unlinked;
    an empty table gives no rows; other columns are not read.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(docs.mapInArrow(_profile(k, percent), "doc_id long, n long, h1 long, h2 long, prefix array<long>"), "shingle-sets")
    some = sets.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n")), "shingle-classes")

    def repeated(tokens: DataFrame) -> DataFrame:
        often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
        return tokens.join(often.hint("shuffle_hash"), "token")

    tokens = some.select("h1", "h2", F.explode("prefix").alias("token"))
    mine = repeated(tokens).select("h1", "h2", "token").groupBy("h1", "h2").agg(F.collect_set("token").alias("seen")).select("h1", "h2", F.size("seen").alias("r"))
    least_n = F.ceil(F.col("n") * percent / 100.0)
    asked = F.greatest(F.lit(1), F.floor(least_n / LESS))  # a partner has at least percent of n tokens
    wanted = written(mine.join(classes, ["h1", "h2"]).where(F.col("r") >= asked).select("node", "h1", "h2", "n"), "candidates")
    ids = wanted.select(F.col("node").alias("doc_id"))
    n_wanted = wanted.count()
    ids = F.broadcast(ids) if n_wanted <= SENT_IDS else ids
    full = written(docs.join(ids, "doc_id", "left_semi").mapInArrow(_full(k), "node long, tokens array<long>, h1 long, h2 long, keys array<long>"), "full-sets")
    if full.count() > n_wanted:  # an id has several rows
        once = full.join(wanted.select("node", "h1", "h2"), ["node", "h1", "h2"], "left_semi").groupBy("node", "h1", "h2").agg(
            F.first("tokens").alias("tokens"), F.first("keys").alias("keys"))
        full = written(once.select("node", "tokens", "h1", "h2", "keys"), "full-sets-once")

    tokens = full.select("node", F.explode("tokens").alias("token"))
    mine = repeated(tokens).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("seen"))
    mine = mine.join(wanted.select("node", "n"), "node").withColumn("m", least_n.cast("int")).where(F.size("seen") >= F.col("m"))
    nodes = written(mine.select("node", "n", F.expr(
        "transform(slice(seen, 1, size(seen) - m + 1), (s, i) -> named_struct('token', s.token, 'rest', size(seen) - i))").alias("probes")), "probes")
    whole = written(full.select("node", "tokens", "keys").join(nodes.select("node"), "node", "left_semi"), "whole-sets")
    discard(full, wanted)
    done = [nodes, whole]

    # groups: each class against the first of those that share a key with it
    keys = whole.select("node", F.posexplode("keys").alias("order", "key"))
    first = keys.groupBy("order", "key").agg(F.min("node").alias("b"), F.count("*").alias("size")).where("size > 1")
    pairs = keys.join(first, ["order", "key"]).where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    whole = whole.select("node", "tokens")
    both = pairs.join(whole.withColumnsRenamed({"node": "a", "tokens": "x"}), "a").join(whole.withColumnsRenamed({"node": "b", "tokens": "y"}), "b")
    near = written(both.mapInArrow(_verified(percent), "a long, b long"), "leader-links")
    comps = components(near)
    nodes = written(nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")

    # token-group matrix; parts of a group by size of the sets, so that a part holds a bounded number of tokens
    part = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    counts = nodes.groupBy("component", part.alias("part")).agg(F.count("*").alias("members")).withColumn(
        "parts", F.ceil(F.col("members") / F.greatest(F.lit(1), F.floor(F.lit(GROUP_TOKENS) / F.pow(F.lit(2.0), "part")))))
    placed = nodes.withColumn("part", part).join(counts, ["component", "part"]).withColumn(
        "g", F.struct("component", "part", F.pmod(F.xxhash64("node"), "parts").alias("nr")))
    sizes = nodes.groupBy("component").agg(F.count("*").alias("size"))
    matrix = placed.join(sizes, "component").select("component", "size", "g", "node", "n", F.explode("probes").alias("_p"))
    matrix = matrix.select("component", "size", "g", "node", "n", "_p.token", "_p.rest")
    open_tokens = matrix.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    matrix = written(matrix.join(open_tokens, "token"), "token-groups")
    groups = matrix.groupBy("token", F.struct("size", "component").alias("theirs"), "g").agg(F.max("rest").alias("rest_g"), F.min("n").alias("least_n"))
    asks = matrix.select("token", F.struct("size", "component").alias("mine"), F.col("node").alias("q"), F.col("n").alias("nq"), "rest")
    # the first token in order that two sets share bounds their overlap by what comes from there on; a group's part holds
    # sets of 2^part to 2^(part+1) - 1 tokens
    reach = F.least("rest", "rest_g") * (100 + percent) >= (F.col("nq") + F.col("least_n")) * percent
    fits = (F.pow(F.lit(2.0), F.col("g.part") + 1) * 100 > F.col("nq") * percent) & (F.pow(F.lit(2.0), F.col("g.part")) * percent <= F.col("nq") * 100)
    found = asks.join(groups, "token").where(F.expr("mine < theirs") & reach & fits).select("q", "g").distinct()
    found = written(found, "queries")
    members = placed.select("node", "g").join(found.select("g").distinct(), "g", "left_semi")
    unions = written(members.join(whole, "node").select("g", F.explode("tokens").alias("token")).distinct(), "unions")
    query_sets = whole.withColumnsRenamed({"node": "q", "tokens": "x"})
    bound = found.join(query_sets, "q").select("q", "g", F.size("x").alias("nq"), F.explode("x").alias("token")).join(unions, ["g", "token"])
    bound = bound.groupBy("q", "g", "nq").agg(F.count("*").alias("_in")).where(F.col("_in") * 100 >= F.col("nq") * percent).select("q", "g")
    bound = written(bound, "qualified")
    portions = bound.groupBy("g").agg(F.ceil(F.count("*") / F.lit(PORTION)).alias("_portions"))
    asked_sets = bound.join(portions, "g").select("q", "g", F.pmod(F.xxhash64("q"), "_portions").alias("portion")).join(query_sets, "q")
    bodies = members.join(portions, "g").withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_portions") - 1))).join(whole, "node")
    at = [F.col("g.component").alias("component"), F.col("g.part").alias("part"), F.col("g.nr").alias("nr"), "portion"]
    by = ["component", "part", "nr", "portion"]
    more = asked_sets.select(*at, "q", "x").groupBy(*by).cogroup(bodies.select(*at, "node", "tokens").groupBy(*by)).applyInArrow(_opened(percent), "a long, b long")
    more = written(more, "group-links")
    comps = components(near.unionByName(more))
    discard(*done, near, nodes, matrix, found, unions, bound, more)

    named = sets.select("doc_id", "n", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"], "left").join(comps, "node", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.coalesce("component", "node")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns; rows without an id stay."""
    kept = similar_documents(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    return docs.where("doc_id IS NOT NULL").join(kept, F.col("doc_id") == F.col("_id"), "left_semi").unionAll(docs.where("doc_id IS NULL"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))

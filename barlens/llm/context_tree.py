"""Scores of texts under a context tree: Krichevsky-Trofimov estimates of all context lengths, mixed by their weights.

A text is its bytes in UTF-8, A-Z lower-cased, and an end sign; what stands before it counts as end signs.  A byte is eight binary
decisions, each of which has a tree of its own over the bytes before (the nearest first), DEPTH levels deep.  A node knows
how often its decision went either way.  Bottom up its weighted probability is half its own estimate plus half the product
over its children; top down the same numbers say how much of a prediction is the node's own and how much comes from below.  Contexts
that learning never saw predict one half, as in the tree itself, so a node without counts needs no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlens.llm.common import batches_of, byte_slices, discard, held_out, table, written

#: Bytes of context; with the byte itself they make one 64-bit number, so six at most.
DEPTH = 5
#: Levels that one ordered pass climbs: the nodes under one node so many levels up are at most 256 ** LEVELS contexts of 255 decisions.
LEVELS = 2
#: Bytes of text whose grams and words are looked up together: a vocabulary grows far slower than its text.
BLOCK = 32 << 20
#: Longer texts are cut at white space into pieces of about this size; a worker makes the grams of so many bytes at once.
PIECE = 1 << 20
END = 0xFF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_HALF = math.log(0.5)
_SMALL = np.array([math.lgamma(i / 2) if i else 0.0 for i in range(8192)])


def _lgamma(twice: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function at ``twice`` / 2, for whole numbers above 0."""
    x = twice * 0.5
    big = twice >= len(_SMALL)
    out = _SMALL[np.where(big, 1, twice)]
    if big.any():
        y = x[big]
        out[big] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3)
    return out


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(2 * a + 1) + _lgamma(2 * b + 1) - _lgamma(2 * (a + b) + 2) - math.log(math.pi)


# ---- the tree, level by level, for whole subtrees ------------------------------------------------------------------------

def _decisions(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight decisions that lead to each byte, (n, 8): the node (1, then the bits so far behind a leading 1) and the bit taken."""
    steps = np.arange(8)
    return ((byte[:, None] | 256) >> (8 - steps)).astype(np.int64), ((byte[:, None] >> (7 - steps)) & 1).astype(np.int64)


def _grouped(key: np.ndarray, *values: np.ndarray):
    """Distinct keys in order, the place of each row among them, and the sums of the values."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    place = np.empty(len(key), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    return ordered[starts], place, [np.add.reduceat(v[order], starts) if len(key) else v for v in values]


def _leaves(gram: np.ndarray, n: np.ndarray):
    """Nodes of the deepest level from grams (context, then byte) and their counts: key (context, decision), zeros, ones; places of the grams' decisions."""
    node, bit = _decisions(gram & 255)
    key = ((gram >> 8)[:, None] << 8 | node).ravel()
    n = np.repeat(n, 8)
    key, place, (a, b) = _grouped(key, np.where(bit.ravel() == 0, n, 0), np.where(bit.ravel() == 1, n, 0))
    return key, a, b, place.reshape(-1, 8), bit


def _climb(key: np.ndarray, a: np.ndarray, b: np.ndarray, weighted: np.ndarray, levels: int):
    """Levels above nodes, nearest first: (key, zeros, ones, weighted, children's product, place of each child)."""
    out = []
    for _ in range(levels):
        key, place, (a, b, product) = _grouped((key >> 16) << 8 | (key & 255), a, b, weighted)
        weighted = _HALF + np.logaddexp(_estimate(a, b), product)
        out.append((key, a, b, weighted, product, place))
    return out


def _ones(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1.0)


def _descend(levels: list, part: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the top level of ``_climb`` to the nodes below it: the probability of a one already decided, and the weight still open."""
    for _, a, b, weighted, product, place in reversed(levels):
        own = np.exp(_HALF + _estimate(a, b) - weighted)
        part = part + rest * own * _ones(a, b)
        rest = rest * np.exp(_HALF + product - weighted)
        part, rest = part[place], rest[place]
    return part, rest


def _whole(batches: Iterator[pa.RecordBatch], top, rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of some rows that hold all rows of a subtree; ``top`` numbers the subtrees of a sorted partition."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            of = top(t)
            cut = int(np.flatnonzero(of != of[-1])[-1]) + 1 if of[0] != of[-1] else 0
            if cut:
                yield t.slice(0, cut)
                held = t.slice(cut).to_batches()
                n -= cut
    if held:
        yield pa.Table.from_batches(held)


def _np(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


_NODES = "k long, a long, b long, weighted double"
_OPEN = "k long, part double, rest double"


def _sending_up(deepest: bool, levels: int):
    def up(batches):
        for t in _whole(batches, lambda t: _np(t, "_top")):
            if deepest:
                key, a, b, _, _ = _leaves(_np(t, "g"), _np(t, "n"))
                weighted = _estimate(a, b)
            else:
                key, a, b, weighted = (_np(t, c) for c in ("k", "a", "b", "weighted"))
            key, a, b, weighted = _climb(key, a, b, weighted, levels)[-1][:4]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(weighted)], ["k", "a", "b", "weighted"])
    return up


def _sending_down(deepest: bool, levels: int, root: bool):
    """Nodes (or grams) and, unless the subtree's top is the root, the open weights of its top nodes, which come first."""
    def down(batches):
        for t in _whole(batches, lambda t: _np(t, "_top")):
            above = _np(t, "_above")
            tops, t = t.filter(pa.array(above)), t.filter(pa.array(~above))
            if not t.num_rows:
                continue
            if deepest:
                gram = _np(t, "g")
                key, a, b, place, bit = _leaves(gram, _np(t, "n"))
                weighted = _estimate(a, b)
            else:
                key, a, b, weighted = (_np(t, c) for c in ("k", "a", "b", "weighted"))
            climbed = _climb(key, a, b, weighted, levels)
            if root:
                part, rest = np.zeros(len(climbed[-1][0])), np.ones(len(climbed[-1][0]))
            else:
                order = np.argsort(_np(tops, "k"), kind="stable")
                at = order[np.searchsorted(_np(tops, "k")[order], climbed[-1][0])]
                part, rest = _np(tops, "part")[at], _np(tops, "rest")[at]
            part, rest = _descend(climbed, part, rest)
            if deepest:
                one = (part + rest * _ones(a, b))[place]
                bits = np.where(bit == 1, one, 1.0 - one)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.log10(bits).sum(axis=1))], ["g", "log10_p"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), pa.array(rest)], ["k", "part", "rest"])
    return down


def probabilities(grams: DataFrame, depth: int = DEPTH, levels: int = LEVELS) -> DataFrame:
    """(g, log10_p): the tree's probability of each gram's byte after its context, from distinct grams (g, n).

    g holds the context, the nearest byte in the highest place, and the byte in the lowest; n is how often learning saw it, 0 for
    grams that are only asked for.  A pass climbs ``levels`` levels for whole subtrees, which lie in one sorted
    run of a partition and whose size the alphabet bounds; it hands on one row per node of its top level.  On the
    way back each pass gets the open weights of its top nodes.  The table of a level is narrow and written between the passes.
    """
    cuts = [*range(depth, 0, -levels), 0]
    tables = [grams.select("g", "n")]
    for low, high in zip(cuts[:-1], cuts[1:-1]):
        shift = 8 * (low - high) + 8
        key = "g" if low == depth else "k"
        given = tables[-1].withColumn("_top", F.shiftright(key, shift))
        climbed = given.repartition("_top").sortWithinPartitions("_top").mapInArrow(_sending_up(low == depth, low - high), _NODES)
        tables.append(written(climbed, "tree-up"))
    down = None
    for low, high in reversed(list(zip(cuts[:-1], cuts[1:]))):
        nodes = tables.pop()
        deepest, root = low == depth, high == 0
        key = "g" if deepest else "k"
        given = nodes.withColumn("_top", F.shiftright(key, 8 * (low - high) + 8)).withColumn("_above", F.lit(False))
        if not root:
            given = given.unionByName(down.withColumn("_top", F.shiftright("k", 8)).withColumn("_above", F.lit(True)), allowMissingColumns=True)
        new = given.repartition("_top").sortWithinPartitions("_top").mapInArrow(_sending_down(deepest, low - high, root), "g long, log10_p double" if deepest else _OPEN)
        old, down = down, new if deepest else written(new, "tree-down")
        if not deepest:
            discard(*[x for x in (old, nodes) if x is not None])
    return down


# ---- texts ---------------------------------------------------------------------------------------------------------------

_PIECES = "uid long, doc_id {id}, held_out boolean, piece int, block long, body binary"
_SEEN = "block long, g long, w binary, n long"
_SCORED = "uid long, doc_id {id}, held_out boolean, piece int, n_bytes long, n_tokens long, n_known long, base double, score double"


def _cut(text: bytes, most: int) -> list[tuple[int, int]]:
    """Borders of the pieces of a text; each ends behind white space, so that no word is cut, however long it is."""
    out, a = [], 0
    while len(text) - a > most:
        data = np.frombuffer(text, np.uint8, offset=a)
        gaps = np.flatnonzero(_SPACES[data[:most]])
        if not len(gaps):
            gaps = np.flatnonzero(_SPACES[data])[:1]
            if not len(gaps):
                break
        b = a + int(gaps[-1]) + 1
        out.append((a, b))
        a = b
    return out if out and a == len(text) else [*out, (a, len(text))]


def _pieces(depth: int, block_bytes: int, piece_bytes: int):
    """Rows (uid, doc_id, held_out, text) to pieces: the bytes before, the lower-cased bytes, and behind the last the end sign."""
    before = bytes([END]) * depth

    def cut(batches):
        block, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text")):
                text = _LOWER[np.frombuffer(text.as_py() or b"", np.uint8)].tobytes()
                for j, (a, b) in enumerate(_cut(text, piece_bytes)):
                    lead = (before + text[max(0, a - depth):a])[-depth:]
                    if size > block_bytes:
                        block, size = block + 1, 0
                    size += b - a + 1
                    rows.append((i, j, block, lead + text[a:b] + (b"\xff" if b == len(text) else b"")))
            at, piece, blocks, body = zip(*rows) if rows else ((), (), (), ())
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("uid", "doc_id", "held_out")], pa.array(piece, pa.int32()),
                                              pa.array(blocks, pa.int64()), pa.array(body, pa.binary())], ["uid", "doc_id", "held_out", "piece", "block", "body"])
    return cut


def _bytes(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after the other, and where each begins."""
    offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset:bodies.offset + len(bodies) + 1].astype(np.int64)
    data = np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _grams(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The gram at every place of the pieces but those of the bytes before."""
    n = len(data) - depth
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    v = np.ndarray(n, "<u8", padded.data, 0, (1,)).astype(np.uint64)  # eight bytes from each place on, the first lowest
    context = v & np.uint64((1 << 8 * depth) - 1)
    g = (context << np.uint64(8)) | ((v >> np.uint64(8 * depth)) & np.uint64(255))
    inside = np.ones(n, bool)
    crossing = (starts[1:-1, None] - depth + np.arange(depth)).ravel()
    inside[crossing[crossing >= 0]] = False
    return g[inside].view(np.int64)


def _words(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[pa.Array, np.ndarray]:
    """Words of the pieces, dictionary-encoded, and how many each piece has."""
    clean = data.copy()
    clean[(starts[:-1, None] + np.arange(depth)).ravel()] = 32
    clean[clean == END] = 32  # no byte of a text
    text = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(clean)])
    parts = pc.ascii_split_whitespace(text)
    flat, counts = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    of = np.repeat(np.arange(len(counts)), counts)
    return flat.filter(pa.array(full)).dictionary_encode(), np.bincount(of[full], minlength=len(counts))


def _ends(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """1 for pieces that a text ends with."""
    return (data[starts[1:] - 1] == END).astype(np.int64) * (np.diff(starts) > depth)


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Pieces that follow each other and are of one block; a block may come in more than one part."""
    held, now, size = [], None, 0
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for a, b in zip(cuts := np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1]), [*cuts[1:], len(blocks)]):
            if a == b:
                continue
            if held and (blocks[a] != now or size > 64 << 20):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            now = blocks[a]
            held.append(batch.slice(a, b - a))
            size += held[-1].nbytes
    if held:
        yield pa.Table.from_batches(held)


def _slices(t: pa.Table, depth: int) -> Iterator[pa.RecordBatch]:
    """Parts of a table whose bodies have about PIECE bytes, and no more rows than a gram leaves bits for in 64."""
    most = 1 << min(56 - 8 * depth, 30)
    for batch in t.to_batches():
        for part in byte_slices(batch, batch.schema.get_field_index("body"), PIECE):
            for a in range(0, part.num_rows, most):
                yield part.slice(a, most)


def _runs(grams: np.ndarray, tag: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted grams with a tag of so many bits each: distinct grams, where each begins, and the tags in that order."""
    packed = (grams.view(np.uint64) << np.uint64(bits)) | tag.astype(np.uint64)
    packed.sort()
    key = packed >> np.uint64(bits)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[starts].view(np.int64), starts, (packed & np.uint64((1 << bits) - 1)).view(np.int64)


def _seeing(depth: int):
    """Distinct grams and words of each block and how often its training texts have them; the end sign is the word 0xFF."""
    def seen(batches):
        for t in _by_block(batches):
            block, keys, times, words, counts = t.column("block")[0].as_py(), [], [], [], []
            for part in _slices(t, depth):
                data, starts = _bytes(part.column("body"))
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                key, at, flag = _runs(_grams(data, starts, depth), np.repeat(train, np.diff(starts) - depth), 1)
                keys.append(key)
                times.append(np.add.reduceat(flag, at) if len(at) else flag)
                if sum(map(len, keys)) > 1 << 20:
                    g, _, (n,) = _grouped(np.concatenate(keys), np.concatenate(times))
                    keys, times = [g], [n]
                coded, per = _words(data, starts, depth)
                words += [coded.dictionary.cast(pa.binary()), pa.array([b"\xff"])]
                counts += [np.bincount(coded.indices.to_numpy(), np.repeat(train, per), len(coded.dictionary)), [(_ends(data, starts, depth) * train).sum()]]
            g, _, (n,) = _grouped(np.concatenate(keys), np.concatenate(times))
            for a in range(0, len(n), 1 << 18):
                m = len(n[a:a + (1 << 18)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(g[a:a + m]), pa.nulls(m, pa.binary()), pa.array(n[a:a + m])], ["block", "g", "w", "n"])
            coded = pa.concat_arrays(words).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), np.concatenate(counts), len(coded.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.nulls(len(n), pa.int64()), coded.dictionary, pa.array(n)], ["block", "g", "w", "n"])
            pa.default_memory_pool().release_unused()
    return seen


def _scoring(depth: int, total: int, distinct: int):
    names = [f.split()[0] for f in _SCORED.split(", ")]

    def scored(pieces: pa.Table, known: pa.Table) -> pa.Table:
        is_gram = pc.is_valid(known.column("g"))
        g, w = known.filter(is_gram), known.filter(pc.invert(is_gram))
        order = np.argsort(_np(g, "g"))
        keys, values = _np(g, "g")[order], _np(g, "v")[order]
        vocabulary, c = w.column("w").combine_chunks(), _np(w, "v")
        del g, w, order
        c_end = c[pc.index_in(pa.array([b"\xff"]), vocabulary)[0].as_py()]
        parts, seen = [], []
        for part in _slices(pieces, depth):
            data, starts = _bytes(part.column("body"))
            sizes = np.diff(starts) - depth
            distinct_g, at, row = _runs(_grams(data, starts, depth), np.repeat(np.arange(len(sizes)), sizes), min(56 - 8 * depth, 30))
            each = np.repeat(values[np.searchsorted(keys, distinct_g)], np.diff(np.append(at, len(row))))
            score = np.bincount(row, weights=each, minlength=len(sizes))  # a text's grams are added in their order, so reruns agree
            words, per = _words(data, starts, depth)
            seen.append(words.dictionary)
            parts.append(([part.column(x) for x in names[:4]], sizes, score, words.indices.to_numpy(), per, _ends(data, starts, depth)))
        # the words of all slices are looked up at once
        found = pc.index_in(pa.concat_arrays([x.cast(pa.binary()) for x in seen]), vocabulary).to_numpy(zero_copy_only=False)
        out, at = [], 0
        for (columns, sizes, score, words, per, ends), distinct_w in zip(parts, seen):
            n = c[found[at:at + len(distinct_w)]][words]
            at += len(distinct_w)
            base = _sums(np.log10((n + 1) / (total + distinct + 1)), per) + ends * np.log10((c_end + 1) / (total + distinct + 1))
            n_known = _sums((n > 0).astype(np.int64), per) + ends * (c_end > 0)
            out.append(pa.RecordBatch.from_arrays([*columns, *[pa.array(x) for x in (sizes - ends, per + ends, n_known, base, score)]], names))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out)
    return scored


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; a run may be empty."""
    out = np.zeros(len(sizes), values.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def tree_scores(docs: DataFrame, held: Column, depth: int = DEPTH, levels: int = LEVELS,
                block_bytes: int = BLOCK, piece_bytes: int = PIECE) -> DataFrame:
    """Scores of all rows of (doc_id, text) under the tree of those where ``held`` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes (with the end sign) and
    bits_per_byte, the code length.  score is the log10 probability of the lower-cased bytes and the end; base_score that of words and end
    under counts plus one.  Learning counts are frozen: a text does not change the tree while it is scored.

    Texts are written once as pieces in blocks of about 32 MB.  A block sends each gram and word it has once, with
    the count; counts are summed over blocks, the tree answers per distinct gram, and a join by gram and by block brings the
    answers to the texts, so what moves is blocks' vocabularies and the texts once.  No table is held by the driver or broadcast.

    Null counts as empty; a null id is not held out; repeated rows are scored and counted each; a long text is
    scored in pieces with its context carried over; without training texts every byte has probability 1/256 and base_score is 0;
    an empty table gives no rows; extra columns are left out.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"),
                        F.col("text").cast("string").cast("binary").alias("text"))
    with batches_of(spark):
        pieces = written(given.mapInArrow(_pieces(depth, block_bytes, piece_bytes), _PIECES.format(id=kind)), "tree-pieces", compression="zstd")
        seen = written(pieces.mapInArrow(_seeing(depth), _SEEN), "tree-seen", compression="zstd")
    words = written(seen.where("w is not null").groupBy("w").agg(F.sum("n").alias("c")), "tree-words")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    grams = written(seen.where("g is not null").groupBy("g").agg(F.sum("n").alias("n")), "tree-grams")
    answers = written(probabilities(grams, depth, levels), "tree-answers")
    known = (seen.where("g is not null").select("block", "g").join(answers, "g").select("block", "g", F.lit(None).cast("binary").alias("w"), F.col("log10_p").alias("v"))
             .unionByName(seen.where("w is not null").select("block", "w").join(words, "w").select("block", F.lit(None).cast("long").alias("g"), "w", F.col("c").cast("double").alias("v"))))
    known = written(known, "tree-known", compression="zstd")  # equal grams lie together: a few bytes a row, and the shuffles of the join are given back
    discard(seen, words, grams, answers)
    scored = pieces.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scoring(depth, size["n"], size["v"]), _SCORED.format(id=kind))
    per = scored.groupBy("uid", "doc_id", "held_out").agg(
        *[F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "n_known")],
        F.array_sort(F.collect_list(F.struct("piece", "base", "score"))).alias("parts"))  # one order, so that reruns add up alike
    def added(name):
        return F.aggregate("parts", F.lit(0.0), lambda s, x: s + x[name])
    out = per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(size["n"]).cast("long").alias("train_tokens"),
                     added("base").alias("base_score"), added("score").alias("score"), (F.col("n_bytes") + 1).alias("n_bytes"))
    with batches_of(spark, 20_000, "8m"):
        out = written(out.withColumn("bits_per_byte", -F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")), "tree-scores")
    discard(pieces, known)
    return out


def op12_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_scores(table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 7, 2))

"""Near duplicates: MinHash signatures joined by Hamming distance through several indexes.

A document's set is its distinct shingles of ``words`` words (A-Z lower-cased). Equal sets are one node. A node's signature
is ``symbols`` minima of 16 bits. Two sets of similarity s differ in a symbol with probability 1 - s, and ``distance`` is
the number of differing symbols that are allowed for (27 of 64: at 0.8 the mean is 12.8, and more than 27 have probability
1e-5). The signature is split into chunks; by pigeonhole some chunk of two signatures within ``distance`` has at most ``errors``
differing symbols, so each chunk is an index under every choice of ``errors`` symbols left out: every pair within the
distance shares a key.

Linking does not list the pairs of a key:

1. A batch of nodes keeps one hub for a key (its least node) and links the others to it; hubs of a key meet after the
   shuffle and link to the least. A key shared by a third of all rows is a row a batch there.
2. Links whose sizes or sketches (a bit a symbol) rule them out are dropped, each node's best link is confirmed on full
   sets, then all links between nodes that are still in different components.
3. Nodes of one component need no more links. Where a key's nodes lie in different components with signatures within the distance,
   these components touch. Touching components form clusters, in which every node but those of the largest component is
   compared with all on full sets, block against block: what a hub did not reach is compared with everything, and only
   confirmed links are listed.

So no link within the distance is lost: sketches may differ in as many bits as signatures in symbols. Components, links and texts
stay in tables in the shared folder.

Cases: null, empty and wordless texts have the empty set and are linked with nothing; fewer words than a shingle are one
shingle; equal sets are linked; null ids take part, and a component's id is the least that isn't null; repeated rows
each give a row; long texts are used whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.session import written

from .common import mix64, slices, split_words, texts_of, unused, word_hashes
from .components import components

SEED = 20_011


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; empty without words."""
    codes, names, offsets = split_words(texts, lower=True)
    flat = mix64(word_hashes(names))[codes] if len(names) else np.empty(0, np.uint64)
    run = np.zeros(max(0, len(flat) - words + 1), np.uint64)
    for k in range(words):
        run = run * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + len(run)]
    run = mix64(run)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in flat[a:b]:
                    whole = whole * np.uint64(0xD6E8FEB86659FD93) + x
            out.append(mix64(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], symbols: int) -> np.ndarray:
    """16-bit symbols, a row a set; none of the sets is empty."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), symbols), np.uint16)
    if not sets:
        return out
    flat = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    for k, f in enumerate(factors):
        least = np.minimum.reduceat(((flat ^ (flat >> np.uint64(31))) * f) >> np.uint64(20), begins)
        out[:, k] = mix64(least).astype(np.uint16)
    return out


def _sign(words: int, symbols: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = shingle_sets(texts_of(part), words)
            full = [k for k, s in enumerate(sets) if len(s)]
            marks = signatures([sets[k] for k in full], symbols)
            node, sign = [None] * len(sets), [None] * len(sets)
            for row, k in enumerate(full):
                node[k] = xxhash.xxh64_intdigest(sets[k].tobytes()) - (1 << 63)
                sign[k] = marks[row].tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("print"), pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sign, pa.binary())],
                names=["doc_id", "print", "node", "n", "sign"],
            )

    return run


def _plan(symbols: int, distance: int, errors: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """Index keys: (first symbol, past the last, symbols left out). Chunks are as many as the pigeonhole needs."""
    chunks = distance // (errors + 1) + 1
    edges = [symbols * k // chunks for k in range(chunks + 1)]
    return [(a, b, out) for a, b in zip(edges, edges[1:]) for out in combinations(range(a, b), min(errors, b - a - 1))]


def _allowed(na, nb, bits, least: int, sketch: int):
    return (bits <= sketch) & (100 * np.minimum(na, nb) >= least * np.maximum(na, nb))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64))


def _keys_of(part: pa.RecordBatch, symbols: int, plan) -> np.ndarray:
    sign = np.frombuffer(b"".join(part.column("sign").to_pylist()), np.uint16).reshape(-1, symbols).astype(np.uint64)
    draw = np.random.default_rng(SEED + 1)
    factor = draw.integers(0, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = draw.integers(0, 2**63, len(plan), dtype=np.uint64)
    terms = (sign + np.uint64(1)) * factor
    sums = {}
    keys = np.empty((len(sign), len(plan)), np.uint64)
    for k, (a, b, out) in enumerate(plan):
        if (a, b) not in sums:
            sums[a, b] = terms[:, a:b].sum(axis=1, dtype=np.uint64)
        keys[:, k] = mix64(sums[a, b] - terms[:, list(out)].sum(axis=1, dtype=np.uint64) + salt[k])
    return keys.view(np.int64)


KEYED = "pair boolean, key long, node long, hub long, n int, bits long"


def _keyed(key, node, hub, n, bits, pair: bool) -> pa.RecordBatch:
    cols = [pa.array(np.full(len(key), pair)), pa.array(key, pa.int64()), pa.array(node, pa.int64()), pa.array(hub, pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in KEYED.split(", ")])


def _first_of(key: np.ndarray) -> np.ndarray:
    """For sorted keys, the index of each key's first row."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return np.repeat(new, np.diff(np.append(new, len(key))))


def _paired(node, hub, passed, bits) -> pa.RecordBatch:
    """Distinct pairs; the distance is 255 for those that only share a key."""
    far = np.where(passed, bits, 255)
    by = np.lexsort((far, hub, node))
    node, hub, far = node[by], hub[by], far[by]
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (hub[1:] != hub[:-1])]) if len(node) else np.empty(0, bool)
    node, hub, far = node[new], hub[new], far[new]
    return _keyed(mix64(node.view(np.uint64)).view(np.int64), node, hub, np.zeros(len(node), np.int32), far, True)


def _emit_keys(symbols: int, plan, least: int, sketch: int):
    """A row a (batch, key) for its hub; pairs with that hub for the batch's other nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column="sign", most=1 << 20):
            key = _keys_of(part, symbols, plan).ravel()
            row = np.repeat(np.arange(part.num_rows), len(plan))
            node, n, bits = (part.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "bits"))
            by = np.lexsort((node[row], key))
            key, row = key[by], row[by]
            hub = row[_first_of(key)]
            own = hub == row
            yield _keyed(key[own], node[row[own]], node[row[own]], n[row[own]], bits[row[own]], False)
            a, b = row[~own], hub[~own]
            apart = _popcount(bits[a] ^ bits[b])
            yield _paired(node[a], node[b], _allowed(n[a], n[b], apart, least, sketch), apart)

    return run


def _meet(least: int, sketch: int):
    """Rows by key and node: the first of a key is its hub, the others pair with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, node, n and bits of the open key's hub
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = batch.column("pair").to_numpy(zero_copy_only=False)
            if pair.any():
                yield batch.filter(pa.array(pair))
            key, node, n, bits = (batch.column(c).to_numpy(zero_copy_only=False)[~pair] for c in ("key", "node", "n", "bits"))
            if not len(key):
                continue
            if last is not None:
                key, node, n, bits = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last, (key, node, n, bits)))
            hub = _first_of(key)
            other = np.flatnonzero(hub != np.arange(len(key)))
            h = hub[other]
            apart = _popcount(bits[other] ^ bits[h])
            if len(other):
                yield _paired(node[other], node[h], _allowed(n[other], n[h], apart, least, sketch), apart)
            last = tuple(x[hub[-1]] for x in (key, node, n, bits))

    return run


def _confirm(words: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for part in slices(iter([batch]), column="text_a"):
                left = shingle_sets(texts_of(part, "text_a"), words)
                good = []
                for s, b, text in zip(left, part.column("b").to_pylist(), part.column("text_b")):
                    if b not in known:
                        known = {b: shingle_sets(pa.array([text.as_py()], pa.large_string()), words)[0]}  # rows come by b
                    t = known[b]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(100 * both >= least * (len(s) + len(t) - both))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    met = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return met.mapInArrow(_confirm(words, least), "a long, b long")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components (nodes without a label are their own)."""
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("label").alias(f"l_{end}"))
        pairs = pairs.join(own, end, "left").withColumn(f"l_{end}", F.coalesce(f"l_{end}", end))
    return pairs.where("l_a <> l_b")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: int = 80, symbols: int = 64, distance: int = 27, errors: int = 1, sketch: int | None = None) -> DataFrame:
    """One row a document: doc_id, print (hash of the text), node (null for the empty set), n_shingles, label (null for
    a node without links): nodes of one label are connected by links of similarity ``least`` percent or more."""
    sketch = distance if sketch is None else sketch  # bits differ only where symbols do: nothing within the distance is lost
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))
    signed = written(base.mapInArrow(_sign(words, symbols), "doc_id long, print long, node long, n long, sign binary"), "near-signs")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("print").alias("print"), F.first("n").cast("int").alias("n"), F.first("sign").alias("sign"))
    nodes = written(nodes.mapInArrow(_sketched(symbols), "node long, print long, n int, sign binary, bits long"), "near-nodes")
    plan = _plan(symbols, distance, errors)
    keyed = nodes.select("node", "n", "bits", "sign").mapInArrow(_emit_keys(symbols, plan, least, sketch), KEYED)
    met = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet(least, sketch), KEYED)
    pairs = written(met.groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.min("bits").alias("d")), "near-pairs")
    live = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    alive = nodes.join(live, "node")
    wanted = alive.groupBy("print").agg(F.first("node").alias("node"))
    texts = written(base.select("print", "text").join(wanted, "print").dropDuplicates(["node"]).select("node", "text"), "near-texts")
    # Each node's best link, then the links left between components.
    near = pairs.where("d < 255")
    best = near.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    links = written(_confirmed(best, texts, words, least), "near-links")
    labels = written(components(links), "near-labels")
    more = written(_confirmed(_labelled(near.select("a", "b").join(best, ["a", "b"], "left_anti"), labels), texts, words, least), "near-links")
    links = links.unionByName(more)
    labels = written(components(links), "near-labels")
    # Keys whose nodes are in different components: those that touch are compared in blocks.
    own = alive.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = own.groupBy("label").agg(F.count("*").alias("members"))
    own = written(own.join(sizes, "label"), "near-own")
    rows = own.select("node", "label", "members", "n", "bits", "sign").mapInArrow(_list_keys(symbols, plan), LISTED)
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    across = rows.join(mixed, "key").join(own.select("node", "sign"), "node").repartition("key").sortWithinPartitions("key", "label")
    touching = written(across.mapInArrow(_across(least, sketch, distance), "a long, b long").distinct(), "near-touching")
    clusters = written(components(touching), "near-clusters").select(F.col("node").alias("label"), F.col("label").alias("other"))
    last = written(_against(own.join(clusters, "label"), texts, words, least), "near-links")
    labels = components(links.unionByName(last)) if last.limit(1).count() else labels
    return signed.select("doc_id", "print", "node", F.col("n").alias("n_shingles")).join(labels, "node", "left")


def _sketched(symbols: int):
    """Adds a bit a symbol (64 symbols at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sign = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint16).reshape(-1, symbols)[:, :64]
            bits = ((sign.astype(np.uint64) & np.uint64(1)) << np.arange(sign.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "print", "n", "sign")), pa.array(bits.view(np.int64))], names=["node", "print", "n", "sign", "bits"])

    return run


LISTED = "key long, node long, label long, members long, n int, bits long"


def _list_keys(symbols: int, plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column="sign", most=1 << 20):
            key = _keys_of(part, symbols, plan)
            row = pa.array(np.repeat(np.arange(part.num_rows), key.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(part.column(c).take(row) for c in ("node", "label", "members", "n", "bits"))], names=[x.split()[0] for x in LISTED.split(", ")])

    return run


def _across(least: int, sketch: int, distance: int):
    """Rows by key and label: components that touch, some node of each within the distance; a star for those of a key."""

    def touching(label, node, members, n, bits, sign):
        names, of = np.unique(label, return_inverse=True)
        root = np.arange(len(names))
        for r in range(0, len(of), 256):
            q = min(len(of), r + 256)
            for at in range(r, len(of), 4096):
                upto = min(len(of), at + 4096)
                near = root[of[r:q]][:, None] != root[of[at:upto]][None, :]
                near &= _allowed(n[r:q, None], n[None, at:upto], _popcount(bits[r:q, None] ^ bits[None, at:upto]), least, sketch)
                x, y = np.nonzero(near)
                for c in range(0, len(x), 1 << 14):
                    i, j = x[c : c + (1 << 14)] + r, y[c : c + (1 << 14)] + at
                    apart = root[of[i]] != root[of[j]]
                    i, j = i[apart], j[apart]
                    close = (sign[i] != sign[j]).sum(axis=1) <= distance
                    for u, v in {tuple(t) for t in np.stack([of[i[close]], of[j[close]]], axis=1).tolist()}:
                        u, v = root[u], root[v]
                        if u != v:
                            root[root == max(u, v)] = min(u, v)
        other = np.flatnonzero(root != np.arange(len(names)))
        return names[other], names[root[other]]

    names = ["label", "node", "members", "n", "bits"]

    def columns(batch):
        sign = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
        return [*(batch.column(c).to_numpy() for c in names), sign]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            cols = columns(batch)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            found = []
            for a, b in zip(starts, np.append(starts[1:], len(key))):
                if open_ is not None and key[a] != open_:
                    found.append(touching(*(np.concatenate(x) for x in zip(*held))))
                    held = []
                open_ = key[a]
                held.append([c[a:b] for c in cols])
            if found:
                node, other = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])
        if held:
            node, other = touching(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])

    return run


BLOCK = 128


def _compare_blocks(words: int, least: int):
    """Confirmed links between two blocks of texts: one counts table for all members, a lookup for each node asked."""

    def run(key, asked, members):
        out = []
        if asked.num_rows and members.num_rows:
            mine = [shingle_sets(texts_of(t, "text"), words) for t in (asked, members)]
            number, begins = np.cumsum([0, *map(len, mine[1])]), None
            names, flat = np.unique(np.concatenate(mine[1]), return_inverse=True)
            begins, sizes = number[:-1], np.diff(number)
            nodes, labels = members["node"].to_pylist(), members["label"].to_numpy()
            own_labels = dict(zip(asked["node"].to_pylist(), asked["label"].to_pylist()))
            for s, node in zip(mine[0], asked["node"].to_pylist()):
                mark = np.isin(names, s, assume_unique=True)
                both = np.add.reduceat(mark[flat], begins, dtype=np.int64)
                hit = np.flatnonzero(100 * both >= least * (len(s) + sizes - both))
                hit = hit[labels[hit] != own_labels[node]]
                out += [(node, nodes[k]) for k in hit[np.unique(labels[hit], return_index=True)[1]].tolist()]  # one for a component
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _against(members: DataFrame, texts: DataFrame, words: int, least: int) -> DataFrame:
    """Confirmed links within clusters of components that touch: all nodes but those of the largest component, against all.

    ``members``: node, label, members (of the component), other (the cluster). Blocks of nodes meet blocks of nodes.
    """
    slot = lambda c, n: F.pmod(F.xxhash64(c), n)
    members = members.select(*[F.col(c).alias(c) for c in ("node", "label", "members", "other")])
    load = members.groupBy("other").agg(F.max(F.struct("members", "label")).alias("most"), F.count("*").alias("all"))
    load = load.select("other", F.col("most.label").alias("largest"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("most.members")) / BLOCK).alias("asks"))
    load = written(load, "near-load")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = members.join(load, "other")
    ask = met.where("label <> largest").withColumn("x", slot("node", F.col("asks"))).withColumn("y", upto("blocks"))
    ask = ask.select("other", "x", "y", "node", "label").join(texts, "node")
    member = met.withColumn("y", slot("node", F.col("blocks"))).withColumn("x", upto("asks"))
    member = member.select("other", "x", "y", "node", "label").join(texts, "node")
    own_names = lambda df: df.select(*[F.col(c).alias(c) for c in ("other", "x", "y", "node", "label", "text")])
    ask, member = own_names(ask), own_names(member)  # both come from the same tables
    return ask.groupBy("other", "x", "y").cogroup(member.groupBy("other", "x", "y")).applyInArrow(_compare_blocks(words, least), "a long, b long")


def find_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    linked = link(docs, **options)
    group = F.coalesce("label", "node")
    least = linked.where("node IS NOT NULL").groupBy(group.alias("g")).agg(F.min("doc_id").alias("component"))
    met = linked.join(least, group == F.col("g"), "left")
    of = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return met.select("doc_id", "n_shingles", of.alias("component_id"), F.coalesce(F.col("doc_id") == of, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all columns: of each component the one with the least (id, hash of the text), a null id
    last. Documents without words all stay, and so do rows equal in id and text."""
    linked = link(docs, id_col=id_col, text_col=text_col, **options)
    group = F.coalesce("label", "node")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print"))
    stay = linked.where("node IS NOT NULL").groupBy(group.alias("g")).agg(least.alias("x")).select("x.doc_id", "x.print")
    stay = stay.unionByName(linked.where("node IS NULL").select("doc_id", "print")).distinct()
    i, p = unused(docs, "near_id"), unused(docs, "near_print")
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    stay = stay.select(F.col("doc_id").alias(i), F.col("print").alias(p))
    return docs.join(stay, (F.xxhash64(text) == F.col(p)) & own.eqNullSafe(F.col(i)), "left_semi")


def oracle(words: int = 2, least: int = 80, table: str = "documents") -> str:
    """Exact SQL for ``find_near_duplicates``: every pair that shares a shingle, then the closure of the links."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM {table}),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {words} THEN [list_slice(ws, i, i + {words} - 1) FOR i IN range(1, len(ws) - {words} + 2)] WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS gram
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
h AS (SELECT doc_id, hash(gram) AS gram FROM g),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM h x JOIN h y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {least} * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""

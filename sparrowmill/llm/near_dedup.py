"""Near-duplicate groups by an LSH forest over MinHash signatures, links confirmed on full sets.

A signature has 63 minima of 16 bits.  Tree t of the forest is the order of all signatures read
from minimum 3t on (and around).  Documents that share a prefix of three minima in a tree are
one region of it.  A pair of similarity 0.75 shares a region in one of the 21 trees with probability
1 - (1 - 0.75^3)^21, that is all but 1e-5.

* Equal sets are one class from the start, so groups of copies cost one row each.
* All trees are sorted at once by ranges of (tree, prefix, following minima, id); ranges cut through
  regions, so a hot one is dealt over many tasks.  Neighbours in the order have the longest
  common prefix and are the first candidates, if they share a region.  Each class has its
  best neighbours confirmed on full sets, the links give components, and what neighbours are still
  in different ones are tried once more.
* Then every region that still holds several components is searched in full: what lies outside its
  largest component against all of the region, dealt in cells of bounded size.  Where that is long,
  the region is deepened first: it becomes one region of the next depth for each later tree.  A pair
  is looked at only in the first region that it shares, and goes on to the full sets if its signatures
  agree often enough and sketches (the 256 smallest hashes of each set, so all of a short text)
  don't rule it out.  So copies aren't expanded into all pairs, and no link is left out.

`Limits` holds what is uncertain, with the odds for a pair of similarity 0.75; `EXACT` switches
signature counts, sketches and deepening off, so that every pair that shares a region is tested on full sets.

Defined results: null, empty and blank texts have n_shingles 0 and link with nothing, as do rows
without a doc_id (component null, kept); rows that share a doc_id are one document, whose text for
linking is the one of least fingerprint (n_shingles is each row's own); the smallest doc_id of
a group stays; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as S
from .common import among, begin, discard, lookup, map_batches, pick, small, stash, table, texts_of
from .graphs import components

DEPTH, TREES, AFTER = 3, 21, 4
MINIMA = DEPTH * TREES
#: Hashes in a sketch; hashes of 32 bits that may collide; rows of a cell on each side; how often neighbours are tried.
SKETCH, COLLISIONS, CELL, ROUNDS = 256, 2, 4096, 2


class Limits(NamedTuple):
    """agree: least number of equal minima (6e-8 of the pairs at 0.75 have fewer); deviations: how many
    standard deviations below 0.75 a sampled similarity may be (2e-8); deep: comparisons of a region
    from which on it is deepened (at 0.75, 1.6e-4 of the pairs share no second region)."""

    agree: int = 28
    deviations: float = 5.5
    deep: int = 1 << 32


EXACT = Limits(0, 1e9, 1 << 62)


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _short(minima: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, by a multiplication that doesn't lose the order of magnitude's bits only."""
    return (minima * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _signed(batch: pa.RecordBatch) -> dict:
    a, b = S.coefficients(MINIMA)
    n, fp, sig = [], [], []
    for s in S.shingle_sets(texts_of(batch.column(1))):
        n.append(len(s))
        fp.append(S.fingerprint(s))
        sig.append(_short(S.signature(s, a, b)).tobytes() if len(s) else b"")
    return {"doc_id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "fp": _binary(fp), "sig": _binary(sig)}


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (128 bits of the set), sig (63 minima of 16 bits)."""
    return map_batches(pick(docs, "doc_id", "text"), _signed, "doc_id long, n_shingles long, fp binary, sig binary")


def one_text_per_id(signed: DataFrame) -> DataFrame:
    """doc_id, fp, sig, n, own_n: rows that share a doc_id get the text of least fingerprint; rows without an id or words are left out."""
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    again = stash(some.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1"))
    plain = some.select("doc_id", "fp", "sig", F.col("n_shingles").alias("n"), F.col("n_shingles").alias("own_n"))
    if again.isEmpty():
        return plain
    ids = again.select("doc_id")
    first = stash(among(some, ids, "doc_id").groupBy("doc_id").agg(F.min(F.struct("fp", "sig", F.col("n_shingles").alias("n"))).alias("c"), F.count("*").alias("k")))
    rows = lookup(some.select("doc_id", F.col("n_shingles").alias("own_n")), first, "doc_id", "k")
    return among(plain, ids, "doc_id", "left_anti").unionByName(rows.select("doc_id", "c.fp", "c.sig", "c.n", "own_n"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, MINIMA)


def _packed(minima: np.ndarray) -> np.ndarray:
    """Up to four minima, one after the other, in a 64-bit word (last axis)."""
    out = np.zeros(minima.shape[:-1], np.int64)
    for k in range(minima.shape[-1]):
        out = out << 16 | minima[..., k].astype(np.int64)
    return out


def _planted(batch: pa.RecordBatch) -> dict:
    """For each tree: the region (tree and prefix), the minima that follow, and the class."""
    sig = _matrix(batch.column("sig"))
    bands = _packed(sig.reshape(len(sig), TREES, DEPTH)) | np.arange(TREES, dtype=np.int64)[None, :] << 48
    places = (np.arange(TREES)[:, None] * DEPTH + DEPTH + np.arange(AFTER)[None, :]) % MINIMA
    return {"region": bands.reshape(-1), "after": _packed(sig[:, places]).reshape(-1), "cid": np.repeat(batch.column("cid").to_numpy(zero_copy_only=False), TREES)}


def _depth(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of neighbours that share a region."""
    differ = (x ^ y).view(np.uint64)
    return DEPTH + sum((differ >> np.uint64(16 * k) == 0).astype(np.int32) for k in range(AFTER))


MEMBER, PAIR, EDGE = 0, 1, 2


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the sorted trees: members of regions with more than one class, neighbours that share a region, and the range's ends."""

    def rows(kind: int, region, a, b, depth=None) -> pa.RecordBatch:
        depth = np.zeros(len(region), np.int32) if depth is None else depth
        return pa.RecordBatch.from_pydict({"kind": np.full(len(region), kind, np.int32), "region": region, "a": a, "b": b, "depth": depth.astype(np.int32)})

    begin(__name__)
    held, told = None, False  # the last row so far, and whether it has been told as a member
    for whole in batches:
        for batch in small(whole, 1 << 16):
            region, after, cid = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            if held is None:
                yield rows(EDGE, region[:1], cid[:1], after[:1])
            else:
                region, after, cid = (np.concatenate([[h], x]) for h, x in zip(held, (region, after, cid)))
            same = region[1:] == region[:-1]
            member = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            held_again = told and held is not None
            told = bool(member[-1]) or (held_again and len(region) == 1)
            if held_again:
                member[0] = False
            held = region[-1], after[-1], cid[-1]
            if same.any():
                x, y = cid[:-1][same], cid[1:][same]
                yield rows(PAIR, region[1:][same], np.minimum(x, y), np.maximum(x, y), _depth(after[:-1][same], after[1:][same]))
            if member.any():
                yield rows(MEMBER, region[member], cid[member], cid[member])
    if held is not None:
        yield rows(EDGE, *(np.array([held[k]], np.int64) for k in (0, 2, 1)))


def forest(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (region, cid) of regions with several classes, pairs (a, b, depth: summed over the trees) of neighbours, and what both are read from."""
    spark = classes.sparkSession
    rows = map_batches(classes.select("cid", "sig"), _planted, "region long, after long, cid long")
    order = ("region", "after", "cid")
    got = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walked, "kind int, region long, a long, b long, depth int"))
    # two rows for each range; what one range ends with and the next begins with are neighbours, too
    ends = sorted({(r["region"], r["b"], r["a"]) for r in got.where(F.col("kind") == EDGE).collect()})
    over = [(x[0], min(x[2], y[2]), max(x[2], y[2]), DEPTH) for x, y in zip(ends, ends[1:]) if x[0] == y[0] and x[2] != y[2]]
    more = spark.createDataFrame(over, "region long, a long, b long, depth int")
    members = got.where(F.col("kind") == MEMBER).select("region", F.col("a").alias("cid"))
    members = members.union(more.select("region", F.explode(F.array("a", "b")).alias("cid")))
    pairs = got.where(F.col("kind") == PAIR).select("a", "b", "depth").union(more.select("a", "b", "depth"))
    return members, pairs.groupBy("a", "b").agg(F.sum("depth").alias("depth")), got


def _alike(n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """Do set sizes allow a similarity of 0.75?"""
    return 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)


def plausible(pairs: DataFrame, classes: DataFrame, limits: Limits) -> DataFrame:
    """a, b, depth, agree: the pairs whose sizes and signatures allow a link."""

    def run(batch: pa.RecordBatch) -> dict:
        agree = (_matrix(batch.column("x")) == _matrix(batch.column("y"))).sum(axis=1)
        ok = (agree >= limits.agree) & _alike(batch.column("nx").to_numpy(zero_copy_only=False), batch.column("ny").to_numpy(zero_copy_only=False))
        return {c: batch.column(c).filter(pa.array(ok)) for c in ("a", "b", "depth")} | {"agree": agree[ok].astype(np.int32)}

    both = pairs.join(classes.select(F.col("cid").alias("a"), F.col("sig").alias("x"), F.col("n").alias("nx")), "a")
    both = both.join(classes.select(F.col("cid").alias("b"), F.col("sig").alias("y"), F.col("n").alias("ny")), "b")
    return map_batches(both, run, "a long, b long, depth long, agree int")


def nearest(pairs: DataFrame) -> DataFrame:
    """Each class's best pair: the one that agrees most, then of longest common prefixes."""
    rank = lambda x: F.struct("agree", "depth", -F.col(x))
    ends = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y"), rank(y).alias("r")) for x, y in ("ab", "ba")])).alias("e"))
    best = ends.groupBy("e.x").agg(F.max_by("e.y", "e.r").alias("y"))
    return best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of a partition sorted by its first column; the last group of a batch waits for the next."""
    begin(__name__)
    rest: list[pa.RecordBatch] = []
    for whole in batches:
        for batch in small(whole, 8192):
            key = batch.column(0).to_numpy(zero_copy_only=False)
            if rest and rest[-1].column(0)[0].as_py() == key[-1]:
                rest.append(batch)
                continue
            cut = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            if cut or rest:
                yield pa.Table.from_batches(rest + ([batch.slice(0, cut)] if cut else []))
            rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def _runs(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])


def _deeper(batch: pa.RecordBatch) -> dict:
    """The regions of the next depth: one for each later tree."""
    sig = _matrix(batch.column("sig"))
    bands = _packed(sig.reshape(len(sig), TREES, DEPTH)).view(np.uint64) | np.arange(TREES, dtype=np.uint64)[None, :] << np.uint64(48)
    region, cid, root, tree = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "cid", "root", "tree"))
    row, later = np.nonzero(np.arange(TREES)[None, :] > tree[:, None])
    keys = S.mix(region[row].view(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + bands[row, later])
    return {"region": keys.view(np.int64), "cid": cid[row], "root": root[row], "tree": ((tree[row] + 1) * 32 + later).astype(np.int32)}


def _torn(owned: DataFrame) -> DataFrame:
    """region, size, least (the size without the largest component), largest: regions that hold several components."""
    by_root = owned.groupBy("region", "root").agg(F.count("*").alias("k"))
    torn = by_root.groupBy("region").agg(F.sum("k").alias("size"), (F.sum("k") - F.max("k")).alias("least"), F.max_by("root", F.struct("k", "root")).alias("largest"))
    return torn.where("least > 0")


def _celled(rows: DataFrame) -> DataFrame:
    """cell, role, cid, root, tree: who is compared with whom.

    The rows outside the largest component are sources (role bit 1), all rows are targets (bit 2).  Both are dealt
    into blocks of about `CELL` rows by hash, and each block of sources meets each block of targets in a cell.
    """
    down, across = (F.ceil(F.col(c) / CELL).cast("int") for c in ("least", "size"))
    i, j = F.pmod(F.xxhash64("cid"), down).cast("int"), F.pmod(F.xxhash64("cid", F.lit(1)), across).cast("int")
    rows = rows.withColumns({"down": down, "across": across}).withColumns({"i": i, "j": j, "source": F.col("root") != F.col("largest")})
    place = lambda a, b, role: F.struct(a.alias("i"), b.alias("j"), role.cast("int").alias("role"))
    none = F.array().cast("array<struct<i:int,j:int,role:int>>")
    as_source = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda c: place(F.col("i"), c, F.when(c == F.col("j"), 3).otherwise(1)))
    as_target = F.transform(F.filter(F.sequence(F.lit(0), F.col("down") - 1), lambda c: ~F.col("source") | (c != F.col("i"))), lambda c: place(c, F.col("j"), F.lit(2)))
    every = F.concat(F.when(F.col("source"), as_source).otherwise(none), as_target)
    rows = rows.select("region", "cid", "root", "tree", F.explode(every).alias("p"))
    return rows.select(F.xxhash64("region", "p.i", "p.j").alias("cell"), "p.role", "cid", "root", "tree")


def cells(owned: DataFrame, classes: DataFrame, limits: Limits) -> DataFrame:
    """The cells of all regions with several components; `owned` has region, cid, root, tree."""
    torn = stash(_torn(owned))
    wide = torn.where(F.col("least") * F.col("size") > limits.deep)
    if wide.isEmpty():
        return _celled(lookup(owned, torn, "region", "size"))
    near = _celled(lookup(owned, torn.where(F.col("least") * F.col("size") <= limits.deep), "region", "size"))
    rows = lookup(owned, wide, "region", "size").join(classes.select("cid", "sig"), "cid").select("region", "cid", "root", "tree", "sig")
    deeper = stash(map_batches(rows, _deeper, "region long, cid long, root long, tree int"))
    return near.union(_celled(lookup(deeper, stash(_torn(deeper)), "region", "size")))


def _first_shared(sig: np.ndarray, i: int, them: np.ndarray, tree: int) -> np.ndarray:
    """Is the region's tree the first in which row i and each of `them` share one (deepened: are its trees the first two)?"""
    same = (sig[them].reshape(-1, TREES, DEPTH) == sig[i].reshape(TREES, DEPTH)).all(axis=2)
    first = same.argmax(axis=1)
    if tree < 32:
        return first == tree
    same[np.arange(len(same)), first] = False
    return (first == tree // 32 - 1) & (same.argmax(axis=1) == tree % 32)


def _met(t: pa.Table, limits: Limits) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of the cell, source row, target rows) in the rows of whole cells, where sizes and signatures allow a link between different components."""
    cell, role, cid, root, tree, n = (t.column(c).to_numpy() for c in ("cell", "role", "cid", "root", "tree", "n"))
    sig = _matrix(t.column("sig"))
    at = _runs(cell)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        targets = a + np.flatnonzero(role[a:b] & 2)
        theirs = np.ascontiguousarray(sig[targets])
        for i in (a + np.flatnonzero(role[a:b] & 1)).tolist():
            ok = (root[targets] != root[i]) & _alike(n[targets], n[i])
            # two that are sources and targets here meet twice
            if role[i] & 2:
                ok &= (role[targets] & 1 == 0) | (cid[targets] > cid[i])
            ok[ok] = (theirs[ok] == sig[i]).sum(axis=1) >= limits.agree
            them = targets[ok]
            if len(them):
                them = them[_first_shared(sig, i, them, int(tree[i]))]
            if len(them):
                yield a, i, them


def _noticed(limits: Limits) -> Callable:
    """The rows of cells that have someone to be tested with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            t = t.combine_chunks()
            hit = np.zeros(len(t), bool)
            for _, i, them in _met(t, limits):
                hit[i] = True
                hit[them] = True
            yield pa.RecordBatch.from_pydict({"cell": t.column("cell").to_numpy()[hit], "cid": t.column("cid").to_numpy()[hit]})

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    """The upper halves of each set's smallest hashes, one row of `SKETCH` places each; places that a short one leaves are the largest value."""
    out = np.full((len(column), SKETCH), 0xFFFFFFFF, np.uint32)
    for k, low in enumerate(column.to_pylist()):
        x = (np.frombuffer(low, np.uint64)[:SKETCH] >> np.uint64(32)).astype(np.uint32)
        out[k, : len(x)] = x
    return out


def _maybe(low: np.ndarray, n: np.ndarray, i: int, them: np.ndarray, deviations: float = Limits().deviations) -> np.ndarray:
    """Which rows of `them` may have a similarity of 0.75 with row i.

    Below the smaller of two sketches' ends both sets are known whole, so what the sketches share
    there is a sample of the union; two short sets are compared in full.
    """
    keep = []
    mine = low[i][: n[i]]
    for at in range(0, len(them), 1024):
        rows = them[at : at + 1024]
        theirs = low[rows]
        end = np.minimum(np.where(n[rows] > SKETCH, theirs[:, -1], 0xFFFFFFFF), mine[-1] if n[i] > SKETCH else 0xFFFFFFFF)
        known = (np.arange(SKETCH)[None, :] < n[rows][:, None]) & (theirs <= end[:, None])
        place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
        both = ((mine[place] == theirs) & known).sum(axis=1)
        union = known.sum(axis=1) + np.searchsorted(mine, end, side="right") - both
        sampled = (n[rows] > SKETCH) | (n[i] > SKETCH)
        keep.append(both + COLLISIONS + np.where(sampled, deviations * np.sqrt(0.1875 * union), 0) >= 0.75 * union)
    return them[np.concatenate(keep)] if keep else them


def _open(limits: Limits) -> Callable:
    """Pairs (a, b) of cells that sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches):
            t = t.combine_chunks()
            cid, n, low = t.column("cid").to_numpy(), t.column("n").to_numpy(), _sketches(t.column("low"))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, i, them in _met(t, limits):
                them = _maybe(low, n, i, them, limits.deviations)
                a.append(np.minimum(cid[them], cid[i]))
                b.append(np.maximum(cid[them], cid[i]))
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _by_cell(rows: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(fn, schema)


def open_pairs(dealt: DataFrame, classes: DataFrame, sets: DataFrame, limits: Limits) -> DataFrame:
    """a, b: the pairs of cells to be tested on full sets.  Sketches go only to rows that signatures leave someone to test with."""
    full = dealt.join(classes.select("cid", "n", "sig"), "cid").select("cell", "role", "cid", "root", "tree", "n", "sig")
    noticed = stash(_by_cell(full, _noticed(limits), "cell long, cid long").distinct())
    low = sets.select("cid", F.substring("s", 1, 8 * SKETCH).alias("low"))
    out = stash(_by_cell(full.join(noticed, ["cell", "cid"]).join(low, "cid").select(*full.columns, "low"), _open(limits), "a long, b long").distinct())
    discard(noticed)
    return out


def _set_batch(batch: pa.RecordBatch) -> dict:
    sets = S.shingle_sets(texts_of(batch.column(1)))
    return {"cid": batch.column(0), "fp": _binary([S.fingerprint(s) for s in sets]), "s": _binary([s.tobytes() for s in sets])}


def full_sets(docs: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """cid, fp, s (sorted 64-bit hashes) of the classes `ids`, from the texts of the documents that they are named after."""
    rows = among(pick(docs, "doc_id", "text").withColumnRenamed("doc_id", "cid"), ids, "cid")
    sets = stash(map_batches(rows, _set_batch, "cid long, fp binary, s binary"))
    if sets.groupBy("cid").count().where("count > 1").isEmpty():
        return sets
    # an id with several rows: the text that its class has
    out = stash(sets.join(classes.select("cid", "fp"), ["cid", "fp"], "left_semi").groupBy("cid").agg(F.first("fp").alias("fp"), F.first("s").alias("s")))
    discard(sets)
    return out


def _linked(batch: pa.RecordBatch) -> dict:
    keep = []
    for x, y in zip(batch.column("sa"), batch.column("sb")):
        p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        i = S.overlap(p, q)
        keep.append(100 * i >= 75 * (len(p) + len(q) - i))
    rows = batch.filter(pa.array(keep, pa.bool_()))
    return {"a": rows.column("a"), "b": rows.column("b")}


def confirmed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full sets have a similarity of 0.75 or more."""
    ids = stash(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct())
    some = among(sets, ids, "cid")
    both = pairs.join(some.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
    both = both.join(some.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    out = stash(map_batches(both, _linked, "a long, b long").distinct())
    discard(ids)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def links(docs: DataFrame, classes: DataFrame, limits: Limits) -> DataFrame:
    """node, root: the components of the classes; a class without links may be missing."""
    members, pairs, walked = forest(classes)
    left = stash(plausible(pairs, classes, limits))
    sets = full_sets(docs, stash(members.select("cid").distinct()), classes)
    found, tested = None, None
    roots = docs.sparkSession.createDataFrame([], "node long, root long")
    for _ in range(ROUNDS):
        picks = stash(nearest(left))
        if picks.isEmpty():
            break
        got = confirmed(sets, picks)
        found, tested = (got, picks) if found is None else (stash(found.union(got)), stash(tested.union(picks)))
        roots = stash(components(found))
        left = stash(_apart(left.join(picks, ["a", "b"], "left_anti"), roots))

    tree = F.shiftright("region", 48).cast("int").alias("tree")
    owned = members.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    owned = stash(owned.select("region", "cid", F.coalesce("root", "cid").alias("root"), tree))
    rest = open_pairs(stash(cells(owned, classes, limits)), classes, sets, limits)
    if tested is not None:
        rest = rest.join(tested, ["a", "b"], "left_anti")
    more = confirmed(sets, stash(rest))
    if not more.isEmpty():
        roots = stash(components(more if found is None else found.union(more)))
    discard(walked, left, owned, more, found, tested, sets)
    return roots


def dedup(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    signed = stash(signatures(docs))
    rows = one_text_per_id(signed)
    classes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("cid"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count("*").alias("k")))
    roots = links(docs, classes, limits)
    named = classes.join(roots.withColumnRenamed("node", "cid"), "cid", "left").select("fp", "k", F.coalesce("root", "cid").alias("component_id"))
    grouped = lookup(rows.select("doc_id", "own_n", "fp"), stash(named), "fp", "k").select("doc_id", F.col("own_n").alias("n_shingles"), "component_id")
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = stash(grouped.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    discard(signed, classes, roots)
    return out


def _row_per_id(flat: DataFrame, key: str, text: str) -> DataFrame:
    """`flat` with one row for each id, that of the least text; rows without an id all stay.

    Only rows whose id repeats are aggregated; copies go together before the shuffle.
    """
    ids = stash(flat.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if ids.isEmpty():
        return flat
    order = F.struct(F.col(text).isNull(), F.col(text))
    last = among(flat, ids, key).select(*flat.columns).groupBy(key).agg(F.min_by(F.struct(*flat.columns), order).alias("_row")).select("_row.*")
    return among(flat, ids, key, "left_anti").select(*flat.columns).union(last)


def one_of_each(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`docs` without the documents whose group keeps another one; of rows that repeat a doc_id one stays."""
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    key, text = (f"_c{names.index(n)}" for n in ("doc_id", "text"))
    gone = stash(dedup(docs, limits).where("NOT kept").select(F.col("doc_id").alias(key)).distinct())
    return among(_row_per_id(flat, key, text), gone, key, "left_anti").select(*flat.columns).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dedup": query}

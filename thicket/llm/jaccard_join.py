"""Exact n-gram Jaccard join by PartEnum signatures, and the groups of documents it links.

**Classes.** Documents with equal shingle sets form a class; only its representative goes on.

**Signatures.** Sets are put into size bands. Two sets of a band with the wanted similarity differ
in at most ``k`` shingles. Shingles are dealt by hash over ``k // 2 + 1`` partitions, each cut into
three parts: in some partition the sets differ in at most one shingle, so two of its three parts
agree. Every pair of parts of every partition is a signature; a set also signs for the next bands, as
far as a partner can lie there. So every similar pair shares a signature.

**Pivots.** A signature shared by many sets is not expanded into pairs: each member is compared with
the first one, its pivot. A parity sketch (a few bits per ten shingles, which bounds the difference
from below) first tells near members from far ones, so unrelated sets that share a weak signature
cost some bytes, not a set. Near members keep their *difference* from the pivot: shingles they have
more and shingles they lack. Two near members of one pivot differ by the symmetric difference of
their differences, so whether they are linked follows exactly from the sizes of these and of what
they share, counted with one sparse product per pivot. Pairs with a far member are settled by the
sketches, by another pivot near to both, by being in one group already, or else by comparing the
texts. Tasks return who is joined, not all pairs.

**First pivots.** A member that is near to several pivots asks for the set of the first one only. What
these links join is settled; another pivot is compared with its members only if it and they are not in
one group yet, so in a group of near copies sets are sent once per block, not once per signature.

**Large groups.** A block sends a signature once, with its first member, however many of its members
have it; the bucket returns the pivot, and the block pairs its own members with it. A pivot with very
many members has them dealt over parts of bounded size. Members that are settled already (linked to
the pivot, so to each other) meet only the parts of those that are not, never one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm import blocks as B
from thicket.llm.components import components
from thicket.llm.hashing import U64, mix, window_hashes, words
from thicket.session import stage

#: Upper over lower size of a band.
BAND_RATIO = 1.5
MESSAGE = "block int, kind int, a binary, b binary"
#: Members, and bytes of their differences, of one part of a pivot's members.
MEMBERS, MEMBER_BYTES = 768, 8 << 20
#: Members of one part where only sketches are compared.
SKETCHES = 4096
#: Ids of open pairs that are broadcast to pick their texts, eight bytes each.
MOST_IDS = 1 << 20
#: Elements in more differences than this are counted by a matrix product.
FREQUENT = 24
_SEEDS = tuple(U64(x) for x in (0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165))
#: A member is far from its pivot if more than this share of the bits of their sketches differ.
FAR = 0.38
DELTA = "p long, x long, p_id long, x_id long, n_p long, n_x long, ins binary, del binary, linked boolean, far boolean, noted boolean, sketch binary"
#: Kinds of messages between blocks: a pair of member and pivot, far members, and near members of later pivots.
PAIR, FAR_NOTE, LATER = 0, 3, 4


class Sets:
    """Distinct shingle hashes of every text of a table: row r has ``hash[first[r]:first[r + 1]]``, sorted."""

    def __init__(self, texts: pa.ChunkedArray, size: int):
        w = words(texts, lower=True)
        word = w.hashes()
        at = w.whole(size)
        doc, value = [w.doc[at]], [window_hashes(word, size)[at]]
        count = np.diff(w.first)
        for short in range(1, size):
            rows = np.flatnonzero(count == short)
            if len(rows):
                doc.append(rows)
                value.append(window_hashes(word, short)[w.first[rows]])
        doc, value = np.concatenate(doc), np.concatenate(value)
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        self.doc, self.hash = doc[new], value[new]
        self.n_words = count
        self.first = np.searchsorted(self.doc, np.arange(len(count) + 1))
        self.size = np.diff(self.first)

    def of(self, row: int) -> np.ndarray:
        return self.hash[self.first[row] : self.first[row + 1]]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit fingerprints of every set."""
        out = []
        for seed in _SEEDS[:2]:
            total = np.zeros(len(self.size), dtype=U64)
            np.add.at(total, self.doc, mix(self.hash ^ seed))
            out.append(total.view(np.int64))
        return out[0], out[1]


class Bands:
    """Size bands and the largest difference inside each, for similarity ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low, self.low, self.k = 1, [], []
        while low < 1 << 40:
            high = max(low, int(low * BAND_RATIO))
            if 2 * low * (den - num) < den + num:  # equal sets only
                high = (den + num - 1) // (2 * (den - num)) if den > num else 1 << 40
            self.low.append(low)
            self.k.append(2 * high * (den - num) // (den + num))
            low = high + 1
        self.low, self.k = np.array(self.low), np.array(self.k)

    def own(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def signatures(sets: Sets, rows: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes of the given rows and the row of each."""
    keys, owners = [np.empty(0, U64)], [np.empty(0, np.int64)]
    size = sets.size[rows]
    own = bands.own(size)
    last = len(bands.low) - 1
    for ahead in range(last + 1):
        band = np.minimum(own + ahead, last)
        pick = bands.k[band] > 0
        if ahead:  # a partner of that band can be similar
            pick &= (own + ahead <= last) & (bands.low[band] * bands.num <= size * bands.den)
        pick = np.flatnonzero(pick)
        if not len(pick):
            if ahead and not ((own + ahead <= last) & (bands.low[band] * bands.num <= size * bands.den)).any():
                break  # bands further on are larger still
            continue
        parts = bands.k[band[pick]] // 2 + 1
        base = np.concatenate([[0], np.cumsum(parts)])
        lengths = size[pick]
        at = np.repeat(sets.first[rows[pick]], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        shingle = sets.hash[at]
        place = mix(shingle ^ _SEEDS[2])
        part = (place % np.repeat(parts, lengths).astype(U64)).astype(np.int64) + np.repeat(base[:-1], lengths)
        third = ((place >> U64(40)) * U64(3) >> U64(24)).astype(np.int64)
        cell = np.zeros(int(base[-1]) * 3, dtype=U64)
        with np.errstate(over="ignore"):
            np.add.at(cell, part * 3 + third, mix(shingle ^ _SEEDS[3]))
            cell = cell.reshape(-1, 3)
            owner = np.repeat(np.arange(len(pick)), parts)
            number = np.arange(int(base[-1])) - base[owner]
            tag = mix(number.astype(U64) * _SEEDS[4] + band[pick][owner].astype(U64))
            for left in range(3):
                right = (left + 1) % 3
                keys.append(mix(mix(cell[:, left] + tag) + cell[:, right] * _SEEDS[0] + U64(left)))
                owners.append(rows[pick][owner])
    return np.concatenate(keys), np.concatenate(owners)


def _node(block: int, row: np.ndarray) -> np.ndarray:
    return (np.int64(block) << np.int64(32)) | row.astype(np.int64)


def star_pairs(table: pa.Table) -> pa.Table:
    """Of one bucket: the pivot of each signature that several blocks have, for all of them but its own.

    Kind 0 is a signature and its pivot, kind 1 who asks for a pivot, kind 2 the signed rows of a block.
    """
    signed = table.filter(pc.is_null(table["key"]))
    block, key, row = B.unpack(table.filter(pc.is_valid(table["key"])), row=np.uint32)
    node = _node(0, row) | (block << 32)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    start = _starts(key)
    pivot = np.repeat(node[start], np.diff(np.append(start, len(key))))
    other = node != pivot
    told, pivot, block = key[other].view(np.int64), pivot[other], node[other] >> 32
    rows = pa.table({"block": signed["block"], "kind": pa.array([2] * len(signed), pa.int32()), "a": signed["row"], "b": pa.nulls(len(signed), pa.binary())})
    return pa.concat_tables([_messages(block, told, pivot, np.stack([pivot, block], axis=1)), rows])


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(ordered, prepend=ordered[:1] ^ U64(1)) != 0) if len(ordered) else np.empty(0, np.int64)


def _requests(x: np.ndarray, p: np.ndarray) -> pa.Table:
    """Pairs for the block of ``x`` (kind 0), and who asks for ``p`` for the block of ``p`` (kind 1)."""
    return _messages(x >> 32, x, p, np.stack([p, x >> 32], axis=1))


def _messages(block: np.ndarray, a: np.ndarray, b: np.ndarray, ask: np.ndarray) -> pa.Table:
    ask = np.unique(ask, axis=0)
    mine = B.to_blocks(block, a=a, b=b)
    asked = B.to_blocks(ask[:, 0] >> 32, a=ask[:, 0], b=ask[:, 1])
    kind = pa.array([0] * len(mine) + [1] * len(asked), pa.int32())
    both = pa.concat_tables([mine, asked])
    return pa.table({"block": both["block"], "kind": kind, "a": both["a"], "b": both["b"]})


def _note(block: int, kind: int, triples: list | np.ndarray) -> pa.Table:
    """Members, pivots and sizes of the pivots' sets, kept for the block itself."""
    data = np.array(triples, dtype=np.int64).tobytes()
    columns = {"block": pa.array([block], pa.int32()), "kind": pa.array([kind], pa.int32()), "a": pa.array([data], pa.binary()), "b": pa.nulls(1, pa.binary())}
    return pa.table(columns)


def _columns(table: pa.Table, kind: int, *names: str) -> np.ndarray:
    """The packed numbers of the rows of one kind, as the distinct rows of a matrix."""
    some = table.filter(pa.array(np.array(table["kind"].to_pylist(), dtype=np.int64) == kind))
    return np.unique(np.stack([B.gather(some, n, np.int64) for n in names], axis=1), axis=0)


def sketch(hashes: np.ndarray, n: int) -> np.ndarray:
    """Parity of how many hashes fall on each bit; sets that differ in ``d`` hashes differ in ``d`` bits at most.

    The number of bits follows ``n``, the size of the pivot's set.
    """
    bits = max(64, 1 << int(n - 1).bit_length())
    return np.packbits((np.bincount((mix(hashes ^ _SEEDS[1]) >> U64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(bool))


def _taken(table: pa.Table, nodes: np.ndarray, size: int) -> tuple[pa.Table, Sets, dict[int, int]]:
    """The rows of a block that ``nodes`` name, their sets, and the place of every node."""
    rows = np.unique(nodes & 0xFFFFFFFF)
    some = B.ordered(table).take(pa.array(rows))
    return some, Sets(some.column("text"), size), {int(r): i for i, r in enumerate(rows)}


class Join:
    """Parameters of one join, and the functions that Spark runs on blocks, buckets and batches."""

    def __init__(self, size: int, num: int, den: int, buckets: int):
        self.size, self.num, self.den, self.buckets = size, num, den, buckets
        self.bands = Bands(num, den)

    def linked(self, n_x: int, n_y: int, differ: int) -> bool:
        """``den * intersection >= num * union``, from the sizes and the size of the difference."""
        return (n_x + n_y) * (self.den - self.num) >= differ * (self.den + self.num)

    def fingerprints(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.batched(batches, B.BLOCK_BYTES, "text"):
            sets = Sets(table.column("text"), self.size)
            f0, f1 = sets.sums()
            yield from pa.table({
                "block": table["block"], "id": table["id"], "n_shingles": pa.array(sets.size, pa.int64()), "f0": pa.array(f0), "f1": pa.array(f1),
            }).to_batches()

    def sign(self, table: pa.Table, reps: pa.Table) -> pa.Table:
        """Packed signatures of the representatives in a block, each once, with its first row; without key the rows that signed."""
        block = (table if len(table) else reps).column("block")[0].as_py()
        wanted = set(zip(reps["id"].to_pylist(), reps["f0"].to_pylist(), strict=True))
        table = B.ordered(table)
        sets = Sets(table.column("text"), self.size)
        rows = []
        for row, name in enumerate(zip(table["id"].to_pylist(), sets.sums()[0].tolist(), strict=True)):
            if name in wanted:
                wanted.discard(name)
                rows.append(row)
        rows = np.array(rows, dtype=np.int64)
        key, owner = signatures(sets, rows, self.bands)
        order = np.lexsort((owner, key))
        first = order[_starts(key[order])]
        sent = B.pack(block, self.buckets, key[first], row=owner[first].astype(np.uint32))
        signed = [block % self.buckets], [block], [None], [rows.astype(np.uint32).tobytes()]
        return pa.concat_tables([sent, pa.table([pa.array(c, t) for c, t in zip(signed, sent.schema.types, strict=True)], schema=sent.schema)])

    def answer(self, table: pa.Table, asked: pa.Table, short: bool) -> pa.Table:
        """Pass a block's pairs, or in short the pivots of its signatures, on to itself, and send the sets of its pivots, or in short their sketches, to the blocks that ask."""
        own, want = _columns(asked, 0, "a", "b"), _columns(asked, 1, "a", "b")
        on = asked.filter(pa.array(np.array(asked["kind"].to_pylist(), dtype=np.int64) >= 2))
        block, kind, node, ids, size, data = [], [], [], [], [], []

        def send(*values) -> None:
            for column, value in zip((block, kind, node, ids, size, data), values, strict=True):
                column.append(value)

        if len(own):
            send(asked["block"][0].as_py(), 0, None, None, None, own.tobytes())
        for b, k, a in zip(*(on[c].to_pylist() for c in ("block", "kind", "a")), strict=True):
            send(b, k, None, None, None, a)
        if len(want):
            some, sets, place = _taken(table, want[:, 0], self.size)
            named = some["id"].to_pylist()
            for p, to in want.tolist():
                row = place[p & 0xFFFFFFFF]
                mine = sets.of(row)
                send(to, 1, p, named[row], len(mine), (sketch(mine, len(mine)) if short else mine).tobytes())
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("block", "kind", "p", "p_id", "n_p", "data"), (block, kind, node, ids, size, data), kinds, strict=True)})

    def triage(self, table: pa.Table, got: pa.Table) -> pa.Table:
        """Pair a block's members with their pivots, and part the pairs by the sketches.

        A member asks for the set of its first near pivot; its later near pivots and its far ones are
        only noted.
        """
        told, pivots = self._received(got, 0, np.uint8)
        rows = [np.frombuffer(x, np.uint32) for k, x in zip(got["kind"].to_pylist(), got["data"].to_pylist(), strict=True) if k == 2]
        near, far, later = [], [], []
        if rows:
            block, sets = got["block"][0].as_py(), Sets(B.ordered(table).column("text"), self.size)
            for x, p in self.members(block, sets, np.concatenate(rows).astype(np.int64), told).tolist():
                if p not in pivots:  # of this block
                    first = sets.of(p & 0xFFFFFFFF)
                    pivots[p] = None, len(first), sketch(first, len(first))
                mine, (_, n, other) = sets.of(x & 0xFFFFFFFF), pivots[p]
                differ = int(np.bitwise_count(sketch(mine, n) ^ other).sum())
                if differ > FAR * 8 * len(other) and not self.linked(len(mine), n, differ):
                    far.append((x, p, n))
                elif near and near[-1][0] == x:  # pairs come by member, then pivot
                    later.append((x, p, n))
                else:
                    near.append((x, p))
        near = np.array(near, dtype=np.int64).reshape(-1, 2)
        notes = [_note(got["block"][0].as_py(), kind, some) for kind, some in ((FAR_NOTE, far), (LATER, later)) if some]
        return pa.concat_tables([_requests(near[:, 0], near[:, 1]), *notes])

    def members(self, block: int, sets: Sets, rows: np.ndarray, told: np.ndarray) -> np.ndarray:
        """Distinct pairs of a member and its pivot: the one told for a signature, else the block's first member that has it."""
        key, owner = signatures(sets, rows, self.bands)
        node = _node(block, owner)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        start = _starts(key)
        pivot = node[start]
        pivot[np.searchsorted(key[start], told[:, 0].view(U64))] = told[:, 1]
        pivot = np.repeat(pivot, np.diff(np.append(start, len(key))))
        return np.unique(np.stack([node, pivot], axis=1)[node != pivot], axis=0)

    @staticmethod
    def _received(got: pa.Table, kind: int, dtype: type) -> tuple[np.ndarray, dict]:
        pairs, pivots = [], {}
        for k, p, p_id, n, data in zip(*(got[c].to_pylist() for c in ("kind", "p", "p_id", "n_p", "data")), strict=True):
            if k == 1:
                pivots[p] = (p_id, n, np.frombuffer(data, dtype))
            elif k == kind:
                pairs.append(np.frombuffer(data, np.int64).reshape(-1, 2 if kind == 0 else 3))
        return np.concatenate(pairs) if pairs else np.empty((0, 2 if kind == 0 else 3), np.int64), pivots

    def differences(self, table: pa.Table, got: pa.Table) -> pa.Table:
        """Compare a block's near members with their pivots; take the sketches of those that are only noted."""
        pairs, pivots = self._received(got, PAIR, U64)
        notes = {kind: self._received(got, kind, U64)[0] for kind in (FAR_NOTE, LATER)}
        out = []
        if len(pairs) or any(map(len, notes.values())):
            some, sets, place = _taken(table, np.concatenate([pairs[:, 0], *[x[:, 0] for x in notes.values()]]), self.size)
            named = some["id"].to_pylist()
            for x, p in pairs.tolist():
                row = place[x & 0xFFFFFFFF]
                mine, (p_id, n, other) = sets.of(row), pivots[p]
                shared = np.intersect1d(mine, other, assume_unique=True)
                ins = np.setdiff1d(mine, shared, assume_unique=True)
                gone = np.setdiff1d(other, shared, assume_unique=True)
                link = self.linked(len(mine), n, len(ins) + len(gone))
                out.append((p, x, p_id, named[row], n, len(mine), ins.tobytes(), gone.tobytes(), link, False, False, sketch(mine, n).tobytes()))
            for kind, triples in notes.items():
                for x, p, n in triples.tolist():
                    row = place[x & 0xFFFFFFFF]
                    mine = sets.of(row)
                    out.append((p, x, None, named[row], n, len(mine), b"", b"", False, kind == FAR_NOTE, True, sketch(mine, n).tobytes()))
        return _delta_table(out)

    def relate(self, table: pa.Table) -> pa.Table:
        """Of some members of one pivot: who is linked, from the sizes of their differences and of what these share."""
        n, linked = table["n_x"].to_numpy(), np.array(table["linked"].to_pylist(), dtype=bool)
        differences = [np.concatenate([np.frombuffer(i, U64), np.frombuffer(d, U64)]) for i, d in zip(table["ins"].to_pylist(), table["del"].to_pylist(), strict=True)]
        d = np.array([len(x) for x in differences])
        differ = d[:, None] + d[None, :] - 2 * shared_elements(differences)
        link = (n[:, None] + n[None, :]) * (self.den - self.num) >= differ * (self.den + self.num)
        label = np.arange(len(n))
        if linked.any():  # all linked to the pivot, so to each other
            label[linked] = np.flatnonzero(linked)[0]
        a, b = np.nonzero(np.triu(link, 1))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new][label]
            if (new == label).all():
                break
            label = new
        u = table["x_id"].to_numpy()
        v = u[label]
        return pa.table({"u": pa.array(u[u != v], pa.int64()), "v": pa.array(v[u != v], pa.int64())})

    def unresolved(self, table: pa.Table) -> pa.Table:
        """Of some members of one pivot: pairs that may be linked by their sketches, are in different groups and have no near pivot in common."""
        n, ids = table["n_x"].to_numpy(), table["x_id"].to_numpy()
        near = [frozenset(x or ()) for x in table["near"].to_pylist()]
        label = table["component"].to_numpy()
        rows = np.stack([np.frombuffer(x, np.uint8) for x in table["sketch"].to_pylist()])
        rows = rows.view(np.uint64) if rows.shape[1] % 8 == 0 else rows
        u, v = [], []
        for i in range(len(n) - 1):
            differ = np.bitwise_count(rows[i + 1 :] ^ rows[i]).sum(axis=1, dtype=np.int64)
            maybe = (n[i + 1 :] + n[i]) * (self.den - self.num) >= differ * (self.den + self.num)
            for j in (np.flatnonzero(maybe & (label[i + 1 :] != label[i])) + i + 1).tolist():
                if near[i].isdisjoint(near[j]):
                    u.append(ids[i]), v.append(ids[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    @staticmethod
    def parted(deltas: DataFrame, weight, members: int, settled) -> DataFrame:
        """Deal the members of every pivot over parts so that each two parts meet under one ``(p, i, j)``.

        Two parts of settled members do not meet, and a pivot with no others is left out. A task then
        holds at most about ``2 * members`` members or ``2 * MEMBER_BYTES``.
        """
        # Hash partitions by p would do for groups by (p, i, j), so without this all parts of a pivot run in one task.
        return Join.dealt(deltas, weight, members, settled).repartition("p", "i", "j")

    @staticmethod
    def dealt(deltas: DataFrame, weight, members: int, settled) -> DataFrame:
        """The rows of :meth:`parted`, still where they lie."""

        def parts(some):
            return F.greatest(F.ceil(F.count_if(some) / members), F.ceil(F.coalesce(F.sum(F.when(some, weight)), F.lit(0)) / MEMBER_BYTES)).cast("int")

        parts = deltas.groupBy("p").agg(parts(~settled).alias("n_open"), parts(settled).alias("n_settled"), parts(F.lit(True)).alias("parts"))
        dealt = deltas.join(parts.where("n_open > 0"), "p").withColumn("settled", settled & (F.col("parts") > 1))
        place = F.pmod(F.xxhash64("x"), F.when(F.col("parts") == 1, 1).when(F.col("settled"), F.col("n_settled")).otherwise(F.col("n_open")))
        dealt = dealt.withColumn("own", (place + F.when(F.col("settled"), F.col("n_open")).otherwise(0)).cast("int"))
        last = F.when(F.col("parts") == 1, 0).when(F.col("settled"), F.col("n_open") - 1).otherwise(F.col("n_open") + F.col("n_settled") - 1)
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), last))).where("parts = 1 OR own <> other")
        return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def edges(self, near: DataFrame) -> DataFrame:
        """Pairs of ids that links join, from the near members of every pivot.

        Members near to the same first pivot are related there; a pivot whose members all have the
        same other first pivot has nothing to add but its own links.
        """
        near = near.select("p", "x", "p_id", "x_id", "n_x", "ins", "del", "linked")
        first = near.groupBy("x").agg(F.min("p").alias("first"))
        ends = near.select("p", "x").join(first, "x").groupBy("p").agg(F.min("first").alias("a"), F.max("first").alias("b"))
        needed = stage(ends.where("a <> b OR a = p").select("p"))  # else all of it is part of the next plan, once for each use
        dealt = self.parted(near.drop("p_id").join(needed, "p", "left_semi"), F.octet_length("ins") + F.octet_length("del"), MEMBERS, F.col("linked"))
        related = dealt.groupBy("p", "i", "j").applyInArrow(lambda t: self.relate(t), "u long, v long")
        return related.unionByName(near.where("linked").select(F.col("x_id").alias("u"), F.col("p_id").alias("v")))

    def leftovers(self, deltas: DataFrame, groups: DataFrame, near: DataFrame | None = None) -> DataFrame:
        """Pairs with a far member that no group or common near pivot has settled and that sketches cannot exclude.

        ``near`` are the near members of every pivot, by default those of ``deltas``. Small tables are
        written on the way: as one plan this is so large that the driver is short of memory for it.
        """
        near = deltas.where("NOT far AND NOT noted") if near is None else near
        touched = stage(deltas.where("far").select("p").distinct())
        # where a member goes is settled without its sketch, which joins it then
        met = stage(deltas.select("p", "x", "x_id", "n_x", "far", F.octet_length("sketch").alias("bytes")).join(touched, "p", "left_semi"))
        members = met.select("x", "x_id").distinct()
        pivots = near.select("p", "x").join(members.select("x"), "x", "left_semi").groupBy("x").agg(F.collect_set("p").alias("near"))
        grouped = members.join(groups.select(F.col("node").alias("x_id"), "component"), "x_id", "left")
        known = stage(grouped.select("x", F.coalesce("component", "x_id").alias("component")).join(pivots, "x", "left"))
        sketches = deltas.select("p", "x", "sketch").join(touched, "p", "left_semi")
        placed = self.dealt(met, F.col("bytes"), SKETCHES, ~F.col("far")).select("p", "x", "x_id", "n_x", "i", "j").join(known, "x")
        dealt = placed.join(sketches, ["p", "x"]).repartition("p", "i", "j")
        return dealt.groupBy("p", "i", "j").applyInArrow(lambda t: self.unresolved(t), "u long, v long")

    def verify(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep pairs of texts that are linked."""
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = pa.Table.from_batches([batch.slice(at, 64)])
                a, b = Sets(part.column("a"), self.size), Sets(part.column("b"), self.size)
                keep = []
                for row in range(len(part)):
                    shared = len(np.intersect1d(a.of(row), b.of(row), assume_unique=True))
                    n, m = len(a.of(row)), len(b.of(row))
                    keep.append(n > 0 and m > 0 and self.linked(n, m, n + m - 2 * shared))
                yield from part.filter(pa.array(keep)).select(["u", "v"]).to_batches()


def shared_elements(lists: list[np.ndarray]) -> np.ndarray:
    """How many elements each two lists share. Frequent elements go through a matrix product, others pair by pair."""
    m = len(lists)
    owner = np.repeat(np.arange(m), [len(x) for x in lists])
    value = np.concatenate(lists) if lists else np.empty(0, U64)
    order = np.lexsort((owner, value))
    owner, value = owner[order], value[order]
    start = np.flatnonzero(np.diff(value, prepend=value[:1] ^ U64(1)) != 0) if len(value) else np.empty(0, np.int64)
    length = np.diff(np.append(start, len(value)))
    out = np.zeros((m, m), dtype=np.int64)
    often = np.flatnonzero(length > FREQUENT)
    for k in range(0, len(often), 2048):
        some = often[k : k + 2048]
        grid = np.zeros((m, len(some)), dtype=np.float32)
        for column, g in enumerate(some):
            grid[owner[start[g] : start[g] + length[g]], column] = 1
        out += np.rint(grid @ grid.T).astype(np.int64)
    rare = np.repeat((length > 1) & (length <= FREQUENT), length)
    owner, group = owner[rare], np.repeat(np.arange(len(length)), length)[rare]
    for shift in range(1, FREQUENT):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(same):
            break
        np.add.at(out, (owner[same], owner[same + shift]), 1)
        np.add.at(out, (owner[same + shift], owner[same]), 1)
    return out


def _delta_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64()] * 6 + [pa.binary()] * 2 + [pa.bool_()] * 3 + [pa.binary()]
    names = ["p", "x", "p_id", "x_id", "n_p", "n_x", "ins", "del", "linked", "far", "noted", "sketch"]
    return pa.table({n: pa.array([r[i] for r in rows], kinds[i]) for i, n in enumerate(names)})


def open_pairs(deltas: DataFrame) -> DataFrame:
    """The noted pairs ``(x, p)`` of later pivots that the links to first pivots leave open, as a written table.

    A pivot that is in one group with all its members has nothing to add to them. Its members are met
    by its far members through their sketches, which the notes hold.
    """
    near = deltas.where("NOT far")
    pairs = near.where("noted")
    groups = components(stage(deltas.where("linked").select(F.col("x_id").alias("u"), F.col("p_id").alias("v"))))
    ends = F.inline(F.array(F.struct(F.col("x").alias("row"), F.col("x_id").alias("node")), F.struct(F.col("p").alias("row"), F.col("p_id").alias("node"))))
    named = near.where("NOT noted").select(ends).distinct()
    member = stage(named.join(groups, "node").select("row", "component"))
    group = F.struct("component", F.when(F.col("component").isNull(), F.col("row")).alias("row"))  # a row that nothing is linked to yet is its own
    later = pairs.select("p").distinct()
    rows = near.join(later, "p", "left_semi").select("p", F.col("x").alias("row")).unionByName(later.select("p", F.col("p").alias("row")))
    spans = rows.join(member, "row", "left").select("p", group.alias("g")).groupBy("p").agg(F.min("g").alias("a"), F.max("g").alias("b"))
    return stage(pairs.join(spans.where("a <> b").select("p"), "p", "left_semi").select("x", "p"))


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct pairs whose ends are not in one group yet, as a written table."""
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    left, right = groups.select(F.col("node").alias("u"), F.col("component").alias("cu")), groups.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    joined = pairs.join(left, "u", "left").join(right, "v", "left")
    return stage(joined.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v"))


def jaccard_groups(
    docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """Link documents whose sets of ``shingle``-word shingles have a Jaccard similarity of ``num / den`` or more.

    Returns one row per input row: ``id_col``, ``n_shingles``, ``component_id`` (smallest id that
    links reach) and ``class_id`` (smallest id with the same set). A text with fewer words than a shingle has one
    shingle, its whole word sequence; a null or blank text has none and is linked with nothing. A
    repeated id names one document. A row without id has the group of its class, if any row of the
    class has an id, else null. Other columns are ignored. An empty table gives an empty result.
    """
    if not 0 < num <= den:
        raise ValueError("num / den must lie in (0, 1]")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts, count = B.text_blocks(docs, "id", "text", block_bytes)
    join = Join(shingle, num, den, B.buckets_for(count))

    rows = stage(texts.mapInArrow(join.fingerprints, "block int, id long, n_shingles long, f0 long, f1 long"))
    same = ["n_shingles", "f0", "f1"]
    classes = rows.where("n_shingles > 0 AND id IS NOT NULL").groupBy(*same).agg(F.min(F.struct("id", "block")).alias("r"))
    classes = classes.select(*same, F.col("r.id").alias("class_id"), F.col("r.block").alias("block"))
    reps = classes.select("block", F.col("class_id").alias("id"), "f0")

    sent = B.cogroup(texts, reps, join.sign, "bucket int, block int, key binary, row binary")
    pairs = sent.groupBy("bucket").applyInArrow(star_pairs, "block int, kind int, a binary, b binary")
    sets = "block int, kind int, p long, p_id long, n_p long, data binary"
    hints = B.cogroup(texts, pairs, lambda a, b: join.answer(a, b, short=True), sets)

    def compared(messages: DataFrame) -> DataFrame:
        given = B.cogroup(texts, messages, lambda a, b: join.answer(a, b, short=False), sets)
        return stage(B.cogroup(texts, given, join.differences, DELTA))

    deltas = compared(B.cogroup(texts, hints, join.triage, MESSAGE))
    near = deltas.where("NOT far AND NOT noted")
    later = open_pairs(deltas)
    if not later.isEmpty():
        asked = later.withColumn("block", F.shiftright("x", 32).cast("int")).groupBy("block")
        near = near.unionByName(compared(asked.applyInArrow(lambda t: _requests(t["x"].to_numpy(), t["p"].to_numpy()), MESSAGE)))
    edges = stage(join.edges(near))
    groups = components(edges)
    open_ = _across(stage(join.leftovers(deltas, groups, near)), groups)
    if open_.count():  # rare: links that only unrelated pivots have seen
        ids = stage(open_.select(F.explode(F.array("u", "v")).alias("id")).distinct())
        few = ids.count() <= MOST_IDS  # else Spark joins the texts by id
        wanted = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        named = stage(wanted.dropDuplicates(["id"]))
        both = open_.join(named.select(F.col("id").alias("u"), F.col("text").alias("a")), "u").join(named.select(F.col("id").alias("v"), F.col("text").alias("b")), "v")
        more = both.select("u", "v", "a", "b").mapInArrow(join.verify, "u long, v long")
        groups = components(edges.unionByName(more))
    groups = groups.select(F.col("node").alias("class_id"), "component")
    out = rows.join(classes.select(*same, "class_id"), same, "left").join(groups, "class_id", "left")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "class_id", "id").alias("component_id"),
        F.coalesce("class_id", "id").alias("class_id"),
    )

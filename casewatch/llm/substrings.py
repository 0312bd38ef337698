"""Repeated passages: bytes covered by a long string that an earlier document also has.

Suffixes are sorted by merging Burrows-Wheeler transforms. Documents are first cut where
their content says so: every string of the asked length has one smallest hash among
its short grams, so equal strings are cut around the same gram (its anchor). Only fragments
whose anchor occurs in two documents can hold a repeated string; they are sent to the bucket of their anchor.
Fragments of an anchor that very many have are cut into their strings first, and each string is sent
to the bucket of its own hash, where equal ones meet as well.
There, anchors by anchors in pieces that a processor's cache holds, the new fragments of one or more packs of
documents are a shard with a Burrows-Wheeler transform, and the transforms are merged by refining how their entries interleave: each round sorts the
entries by the symbols before them within what is known, which extends the known common prefix by
those symbols, until it has the asked length. A round holds only the entries from which the rounds
left come to a string of a fragment. Entries that are then still together begin with
the same string, and the smallest document among them decides.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewatch.llm.buffers import Texts, mix, powers, ragged, slices
from casewatch.session import shared_dir, stage

GRAM, MOST_STRINGS = 16, 100
PACK_BYTES = 4 << 20
HOT = 10_000  # fragments of one anchor, each counted once in a pack, beyond which they are cut into strings
CUT_BYTES = 64 << 10  # of texts that are cut at a time, so that the work stays in a processor's cache
CELLS = 256  # parts of a bucket by anchor, which are merged apart
PIECE_BYTES, SHARD_BYTES = 256 << 10, 32 << 10  # of fragments merged at a time, and of a transform at least
BUCKET_BYTES = 16 << 20  # of texts to a bucket, beyond a least number of buckets
LAST = (1 << 63) - 1  # stands for a null id, which comes after all others
PACKS = "pack long, n_bytes long, doc_ids binary, known binary, sizes binary, data binary"
BLOBS = "bucket int, pack long, hashes binary, numbers binary"
ANSWERS = "bucket int, pack long, hashes binary, hot binary"
FRAGMENTS = "bucket int, pack long, cells binary, lengths binary, firsts binary, data binary"
REPLIES = "bucket int, pack long, runs binary, firsts binary"
REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        doc_ids = batch.column(0)
        known = np.asarray(doc_ids.is_valid()).astype(np.uint8)
        numbers = np.asarray(doc_ids.fill_null(LAST)).astype(np.int64)
        for a, b, texts in slices(batch.column(1), PACK_BYTES):
            row = [(part << 32) + count, len(texts.data), numbers[a:b], known[a:b], np.diff(texts.offsets), texts.data]
            yield _batch([row], ("pack", "n_bytes", "doc_ids", "known", "sizes", "data"))
            count += 1


def _batch(rows: list[list], names: tuple) -> pa.RecordBatch:
    """Rows of whole numbers and arrays; arrays become bytes."""
    kinds = {"pack": pa.int64(), "n_bytes": pa.int64(), "bucket": pa.int32()}
    columns = [
        pa.array([v if isinstance(v, int) else np.ascontiguousarray(v).tobytes() for v in column], kinds.get(n, pa.binary()))
        for n, column in zip(names, zip(*rows))
    ]
    return pa.RecordBatch.from_arrays(columns, list(names))


class Pack:
    """Documents of a pack and the fragments that they are cut into."""

    def __init__(self, row: dict, length: int):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.known = np.frombuffer(row["known"], np.uint8).astype(bool)
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int64))]).astype(np.int64)
        self.texts = Texts(np.frombuffer(row["data"], np.uint8), offsets)
        self._cut(length)

    def _cut(self, length: int) -> None:
        """First string, end of strings, document, anchor hash and content hash of each fragment."""
        starts = range(0, max(1, len(self.texts.data) - length + 1), CUT_BYTES)
        found = zip(*(self._cut_piece(at, length) for at in starts))
        self.first, self.end, self.doc, self.anchor, self.content = (np.concatenate(x) for x in found)

    def _cut_piece(self, at: int, length: int) -> tuple[np.ndarray, ...]:
        """Fragments of the strings that start in a piece of the texts; a fragment ends with its piece."""
        data, window = self.texts.data[at : at + CUT_BYTES + length - 1], length - GRAM + 1
        n, empty = len(data), np.empty(0, np.int64)
        if n < length:
            return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
        sums = Texts(data, self.texts.offsets[:0]).prefix_hash()
        least = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n - GRAM + 1, inverse=True))
        span = 1
        while span * 2 <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        starts = np.arange(n - length + 1)
        offsets = self.texts.offsets - at
        doc = np.repeat(np.arange(len(self.texts)), np.diff(np.clip(offsets, 0, len(starts))))
        whole = starts + length <= offsets[doc + 1]
        new = whole.copy()
        new[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new)
        count = np.add.reduceat(whole.astype(np.int64), first) if len(first) else empty
        parts = -(-count // MOST_STRINGS)  # text that repeats itself has long runs around one gram
        some = np.repeat(first, parts) + MOST_STRINGS * ragged(np.zeros_like(parts), parts)
        end = np.minimum(some + MOST_STRINGS, np.repeat(first + count, parts))
        content = mix((sums[end + length - 1] - sums[some]) * powers(n + 1, inverse=True)[some])
        return some + at, end + at, doc[some], least[some], content

    def split(self, mask: np.ndarray, length: int) -> None:
        """Make fragments of one string out of those of a mask; their content stands for the anchor."""
        if not mask.any():
            return
        strings = (self.end - self.first)[mask]
        first, doc = ragged(self.first[mask], strings), np.repeat(self.doc[mask], strings)
        content = self.texts.hashes(first, first + length)
        self.keep(~mask)
        new = {"first": first, "end": first + 1, "doc": doc, "anchor": content, "content": content}
        for name, values in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), values]))

    def keep(self, mask: np.ndarray) -> None:
        for name in ("first", "end", "doc", "anchor", "content"):
            setattr(self, name, getattr(self, name)[mask])


def _by_bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (values % np.uint64(buckets)).astype(np.int64)


def _cells(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and part of the bucket, as one number."""
    part = (values // np.uint64(buckets)) % np.uint64(CELLS)
    return _by_bucket(values, buckets) * CELLS + part.astype(np.int64)


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, start and end of each run of equal buckets."""
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[a]), int(a), int(b)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _anchors(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct anchors of a pack per bucket, with their numbers of distinct fragments.

    Those that several of its documents have come twice, then with the number 0.
    """
    for row in _rows(batches):
        pack = Pack(row, length)
        several = np.empty(0, np.uint64)
        if len(pack.anchor):
            order = np.argsort(pack.anchor)
            anchor, owner = pack.anchor[order], pack.ids[pack.doc[order]]
            begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            several = anchor[begins[np.minimum.reduceat(owner, begins) < np.maximum.reduceat(owner, begins)]]
        _, one = np.unique(pack.content, return_index=True)  # equal fragments have one anchor
        distinct, numbers = np.unique(pack.anchor[one], return_counts=True)
        values = np.concatenate([distinct, several])
        numbers = np.concatenate([np.minimum(numbers, 65535), np.zeros(len(several), np.int64)]).astype(np.uint16)
        narrow = np.uint16 if buckets <= 1 << 16 else np.int64
        order = np.argsort(_by_bucket(values, buckets).astype(narrow), kind="stable")
        values, numbers = values[order], numbers[order]
        rows = [[b, row["pack"], values[i:j], numbers[i:j]] for b, i, j in _groups(_by_bucket(values, buckets))]
        if rows:
            yield _batch(rows, ("bucket", "pack", "hashes", "numbers"))


def _repeated(table: pa.Table, most: int) -> pa.Table:
    """For each pack, which of its anchors in this bucket two documents have, and which of these are hot.

    Two documents in one pack are known by the repeated entry; an id is one document, so
    rows of one id in two packs are only proposed here and told apart later.
    """
    blobs = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    numbers = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("numbers").to_pylist()])
    values, which, counts = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    twice, hot = values[counts > 1], values[(counts > 1) & (np.bincount(which, numbers) > most)]
    replies = [np.unique(b[_member(b, twice)]) for b in blobs]
    return pa.table(
        [
            table.column("bucket"),
            table.column("pack"),
            pa.array([r.tobytes() for r in replies], pa.binary()),
            pa.array([r[_member(r, hot)].tobytes() for r in replies], pa.binary()),
        ],
        names=["bucket", "pack", "hashes", "hot"],
    )


def _member(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Which values are among sorted members."""
    if not len(members):
        return np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(members, values), len(members) - 1)
    return members[place] == values


def _candidates(pack: Pack, replies: list[bytes], hot: list[bytes], length: int) -> None:
    """Keep the fragments whose anchor is repeated, those of a hot one as strings."""
    wanted, hot = (np.sort(np.concatenate([np.frombuffer(r, np.uint64) for r in x] or [np.empty(0, np.uint64)])) for x in (replies, hot))
    pack.keep(_member(pack.anchor, wanted))
    pack.split(_member(pack.anchor, hot), length)


def _fragment_order(pack: Pack, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fragments by cell and content: an occurrence of each, its smallest document, and where each fragment stands."""
    order = np.argsort(pack.content)
    content = pack.content[order]
    new = np.ones(len(order), bool)
    new[1:] = content[1:] != content[:-1]
    begins = np.flatnonzero(new)
    chosen = order[begins]  # equal fragments have one anchor, and so one cell
    least = np.minimum.reduceat(pack.ids[pack.doc[order]], begins) if len(begins) else begins
    cell = _cells(pack.anchor[chosen], buckets)
    by_cell = np.argsort(cell.astype(np.uint16) if buckets * CELLS <= 1 << 16 else cell, kind="stable")
    rank = np.empty(len(chosen), np.int64)
    rank[by_cell] = np.arange(len(chosen))
    where = np.empty(len(order), np.int64)
    where[order] = rank[np.cumsum(new) - 1]
    return chosen[by_cell], least[by_cell], where


def _fragments(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct candidate fragments of a pack per bucket, with the smallest document that has each."""
    for row in _rows(batches):
        pack = Pack(row, length)
        _candidates(pack, row["replies"], row["hot"], length)
        chosen, least, _ = _fragment_order(pack, buckets)
        size = pack.end[chosen] - pack.first[chosen] + length - 1
        cell, rows = _cells(pack.anchor[chosen], buckets), []
        for b, i, j in _groups(cell // CELLS):
            data = pack.texts.data[ragged(pack.first[chosen[i:j]], size[i:j])]
            data = np.frombuffer(pa.compress(data, codec="zstd", asbytes=True), np.uint8)  # a third less than by the shuffle's codec
            rows.append([b, row["pack"], (cell[i:j] % CELLS).astype(np.uint8), size[i:j].astype(np.uint8), least[i:j], data])
        if rows:
            yield _batch(rows, ("bucket", "pack", "cells", "lengths", "firsts", "data"))


def _letters(texts: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Numbers from 0, in their order, for the bytes that occur; and how many there are, two at least."""
    used = np.zeros(256, bool)
    for text in texts:
        used |= np.bincount(text, minlength=256) > 0
    return (np.cumsum(used) - 1).astype(np.uint64), max(2, int(used.sum()))


def _most(letters: int, bits: int, limit: int) -> int:
    """How many letters one number of some bits holds, up to a limit."""
    return max(k for k in range(1, limit + 1) if k == 1 or letters**k <= 1 << bits)


def shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a text (taken as a circle) by the first `depth` bytes from there, by doubling.

    Positions that stand alone already are left out of the next doubling.
    """
    n, (letter, letters) = len(text), _letters([text])
    bits = n.bit_length()
    known = _most(letters, 64 - bits, depth)
    circle = letter[np.concatenate([text, text[np.arange(known - 1) % n]])]
    key = circle[:n]
    for i in range(1, known):
        key = key * np.uint64(letters) + circle[i : i + n]
    order, new = _sorted_by(key, np.arange(n), 64 - bits)
    begins = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank, slots = np.empty(n, np.int64), np.arange(n)
    while True:
        rank[order[slots]] = begins
        shared = ~(new & np.append(new[1:], True))
        slots = slots[shared]
        if known >= depth or not len(slots):
            return order
        some = order[slots]
        key = (rank[some] << bits | rank[(some + known) % n]).astype(np.uint64)
        order[slots], new = _sorted_by(key, some, 2 * bits)
        begins = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        known *= 2


def _sorted_by(key: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values by their keys, which have some bits, and which of the sorted keys differ from the one before."""
    spare = len(values).bit_length()
    if bits + spare <= 64:  # keys with their places behind them sort faster than places by keys
        both = np.sort(key << np.uint64(spare) | np.arange(len(values), dtype=np.uint64))
        key, order = both >> np.uint64(spare), (both & np.uint64((1 << spare) - 1)).astype(np.int64)
    else:
        order = np.argsort(key)
        key = key[order]
    return values[order], np.concatenate([[True], key[1:] != key[:-1]])


def _before(texts: list[np.ndarray], letter: np.ndarray, letters: int, step: int) -> np.ndarray:
    """The `step` letters before every position as one ordered number."""
    grams = []
    for text in texts:
        own = letter[text]
        gram = np.zeros(len(text), np.uint64)
        for back in range(step, 0, -1):
            gram = gram * np.uint64(letters) + np.roll(own, back)
        grams.append(gram)
    return np.concatenate(grams)


def merged_blocks(texts: list[np.ndarray], depth: int, begins: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Interleave the transforms of shards up to `depth` symbols.

    Returns for each shard its suffix order, and one array with the block of every suffix (all
    shards' suffixes one behind the other, each in its own order): suffixes with the same
    first `depth` bytes have the same block. Each round reads, for every entry of the interleave, the
    symbols before the next suffix of its shard and sorts the entries by them, then by their blocks: the
    entries then stand for suffixes that start that many bytes earlier. Entries are ordered by
    shard within a block, where their order does not matter.

    If only the suffixes that a mask of each text marks are asked for, whose first `depth` bytes
    may not hold the last byte of their text, a round holds only the entries that come to them in the rounds left.
    """
    orders = [shard_order(t, depth) for t in texts]
    letter, letters = _letters(texts)
    moved = np.cumsum([0, *map(len, texts)])
    places = np.concatenate([o + m for o, m in zip(orders, moved)])
    asked = None if begins is None else np.concatenate([np.zeros(depth, bool), *begins])
    n_asked = [len(t) for t in texts] if begins is None else [int(b.sum()) for b in begins]
    total = sum(n_asked)
    shard = np.repeat(np.arange(len(texts)), n_asked).astype(_narrow(len(texts)))
    shard_bits, block_bits = len(texts).bit_length(), total.bit_length()
    block, low = np.zeros(total, np.uint64), np.uint64(shard_bits)
    most = _most(letters, 64 - shard_bits - block_bits, depth)
    grams, left = _before(texts, letter, letters, most), depth
    while left:
        step = -(-left // -(-left // most))  # rounds of about one size
        # The suffix asked for starts `left` bytes before its entry, and `asked` has `depth` more in front.
        entries = places if asked is None else places[asked[places + (depth - left)]]
        read = np.empty(total, np.uint64)
        gram = grams[entries] if step == most else grams[entries] % np.uint64(letters**step)
        read[np.argsort(shard, kind="stable")] = gram
        key = np.sort((read << np.uint64(block_bits) | block) << low | shard.astype(np.uint64))
        shard, key = (key & np.uint64((1 << shard_bits) - 1)).astype(shard.dtype), key >> low
        block = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])[:total], dtype=np.uint64)
        left -= step
    if begins is not None:
        orders = [o[b[o]] for o, b in zip(orders, begins)]
    return block[np.argsort(shard, kind="stable")].astype(np.int64), orders


def _narrow(n: int) -> type:
    """A type for numbers below n; small ones are sorted faster."""
    return np.uint8 if n <= 256 else np.uint16 if n <= 1 << 16 else np.int64


def _merge(table: pa.Table, length: int) -> pa.Table:
    """For each pack's fragments, the smallest document of every string in them, in runs.

    Neighbouring cells are merged together up to some bytes, so what is worked on stays small
    whatever the size of the bucket.
    """
    packs, totals = [], np.zeros(CELLS, np.int64)
    for cells, lengths, firsts, data in zip(*(table.column(n).to_pylist() for n in ("cells", "lengths", "firsts", "data"))):
        cells, lengths = np.frombuffer(cells, np.uint8), np.frombuffer(lengths, np.uint8).astype(np.int64)
        totals += np.bincount(cells, lengths, CELLS).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        data = pa.decompress(data, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True)
        packs.append((cells, lengths, np.frombuffer(firsts, np.int64), np.frombuffer(data, np.uint8), ends))
    piece = (np.cumsum(totals) - totals) // PIECE_BYTES
    answers: list[list] = [[] for _ in packs]
    for _, low, high in _groups(piece):
        some, who = [], []
        for k, (cells, lengths, firsts, data, ends) in enumerate(packs):
            i, j = np.searchsorted(cells, [low, high])
            if i < j:
                some.append((lengths[i:j], firsts[i:j], data[ends[i] : ends[j]]))
                who.append(k)
        for k, answer in zip(who, _merged(some, length) if some else ()):
            answers[k].append(answer)
    columns = [table.column("bucket"), table.column("pack")]
    columns += [pa.array([b"".join(x[k] for x in a) for a in answers], pa.binary()) for k in (0, 1)]
    return pa.table(columns, names=["bucket", "pack", "runs", "firsts"])


def _merged(packs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[tuple[bytes, bytes]]:
    """Runs and smallest documents for the fragments of each pack: their lengths, documents and bytes."""
    size, first = np.concatenate([p[0] for p in packs]), np.concatenate([p[1] for p in packs])
    data = np.concatenate([p[2] for p in packs])
    start = np.cumsum(size) - size
    whole = Texts(data, np.append(start, len(data)))
    content = whole.hashes(start, start + size)
    distinct, seen, which = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(distinct), LAST)
    np.minimum.at(least, which, first)
    # Every fragment belongs to the shard of the first pack that has it; a zero byte ends it.
    # Packs with little share a shard.
    of_pack = np.repeat(np.arange(len(packs)), [len(p[0]) for p in packs])
    new_bytes = np.bincount(of_pack[seen], size[seen], len(packs)).astype(np.int64)
    of_shard = (np.cumsum(new_bytes) - new_bytes) // SHARD_BYTES
    shards, base, at = [], np.empty(len(distinct), np.int64), 0
    by_pack = np.argsort(of_pack[seen], kind="stable")
    for _, i, j in _groups(of_shard[of_pack[seen[by_pack]]]):
        own = by_pack[i:j]
        n = size[seen[own]]
        text = np.zeros(int(n.sum()) + len(own), np.uint8)
        place = np.cumsum(n + 1) - (n + 1)
        text[ragged(place, n)] = data[ragged(start[seen[own]], n)]
        shards.append(text)
        base[own] = at + place
        at += len(text)
    strings = size[seen] - length + 1
    place = ragged(base, strings)
    begins = np.zeros(at, bool)
    begins[place] = True
    moved = np.concatenate([[0], np.cumsum([len(t) for t in shards])])
    block, orders = merged_blocks(shards, length, np.split(begins, moved[1:-1]))
    of_text = np.empty(at, np.int64)
    of_text[np.concatenate([o + m for o, m in zip(orders, moved)])] = block
    owner = np.repeat(np.arange(len(distinct)), strings)
    smallest = np.full(int(block.max()) + 1, LAST)
    np.minimum.at(smallest, of_text[place], least[owner])
    found = smallest[of_text[place]]
    # In runs of equal documents, so that a fragment mostly takes one.
    edge = np.ones(len(found), bool)
    edge[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    run_at = np.flatnonzero(edge)
    run_length = np.diff(np.append(run_at, len(found)))
    run_owner, run_first = owner[run_at], found[run_at]
    first_run = np.searchsorted(run_owner, np.arange(len(distinct) + 1))
    out = []
    for i in range(len(packs)):
        mine = which[of_pack == i]
        taken = ragged(first_run[mine], first_run[mine + 1] - first_run[mine])
        out.append((run_length[taken].astype(np.uint8).tobytes(), run_first[taken].tobytes()))
    return out


def _remove(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        pack = Pack(row, length)
        _candidates(pack, row["replies"] or [], row["hot"] or [], length)
        data, offsets = pack.texts.data, pack.texts.offsets
        cover = np.zeros(len(data) + 1, np.int64)
        if len(pack.first):
            _, _, where = _fragment_order(pack, buckets)
            found = sorted(row["found"] or [], key=lambda x: x["bucket"])
            runs = np.concatenate([np.frombuffer(x["runs"], np.uint8) for x in found]).astype(np.int64)
            least = np.concatenate([np.frombuffer(x["firsts"], np.int64) for x in found])
            # Runs never pass the end of a fragment, so each distinct fragment has whole ones.
            strings = np.zeros(int(where.max()) + 1, np.int64)
            strings[where] = pack.end - pack.first
            place, run_at = np.cumsum(strings) - strings, np.cumsum(runs) - runs
            first_run = np.searchsorted(run_at, np.append(place, len(runs) and run_at[-1] + 1))
            n_runs = np.diff(first_run)[where]
            taken, of = ragged(first_run[where], n_runs), np.repeat(np.arange(len(where)), n_runs)
            earlier = least[taken] < pack.ids[pack.doc[of]]
            taken, of = taken[earlier], of[earlier]
            at = pack.first[of] + run_at[taken] - place[where[of]]
            cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + runs[taken] + length - 1, minlength=len(cover))
        gone = np.cumsum(cover[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
        removed, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begins))
        kept = data[~gone]
        ends = (offsets - removed).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(kept)])
        columns = [pa.array(pack.ids, mask=~pack.known), *(pa.array(np.diff(x)) for x in (offsets, removed, spans)), packed]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, length: int = 50, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row.

    A byte goes if a string of `length` bytes over it also starts in a row with a smaller
    id. Rows of one id are one document in this and never count against each other. A null id
    comes after all others. A null or empty text, and one shorter than `length`, keeps all.
    Kept bytes need not be valid UTF-8, as strings are cut between any bytes. `length` is
    from twice the gram's to 150. Only the two named columns are read. Acts at once.
    """
    if not 2 * GRAM <= length <= 150:
        raise ValueError("length must be between 32 and 150")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Packs are bucketed, so that answers come to them and their texts never move again.
    name = f"packs_{uuid.uuid4().hex}"
    writer = rows.mapInArrow(_pack, PACKS).write.bucketBy(max(64, 4 * partitions), "pack").option("compression", "zstd")
    writer.option("path", f"{shared_dir(spark)}/staging/{name}").saveAsTable(name)
    packs = spark.table(name)
    n_bytes = packs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(64, 4 * partitions, n_bytes // BUCKET_BYTES)

    blobs = packs.mapInArrow(partial(_anchors, length=length, buckets=buckets), BLOBS)
    most = HOT

    def repeat(table: pa.Table) -> pa.Table:
        return _repeated(table, most)

    repeated = blobs.groupBy("bucket").applyInArrow(repeat, ANSWERS)
    lists = [F.collect_list("hashes").alias("replies"), F.collect_list("hot").alias("hot")]
    replies = stage(repeated.groupBy("pack").agg(*lists))
    asked = packs.join(replies, "pack")
    cut = asked.mapInArrow(partial(_fragments, length=length, buckets=buckets), FRAGMENTS)

    def merge(table: pa.Table) -> pa.Table:
        return _merge(table, length)

    merged = cut.groupBy("bucket").applyInArrow(merge, REPLIES)
    found = stage(merged.groupBy("pack").agg(F.collect_list(F.struct("bucket", "runs", "firsts")).alias("found")))
    answered = packs.join(replies, "pack", "left").join(found, "pack", "left")
    return answered.mapInArrow(partial(_remove, length=length, buckets=buckets), REMOVED)

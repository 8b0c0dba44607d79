"""Suffix-array dedup: distributed merge sort of front-coded suffix runs with common-prefix-aware loser trees.

Every byte covered by a 100-byte string that also starts earlier (smaller doc_id, or the same
document and an earlier start) is removed. Not all suffixes need sorting: each 100-byte window is
represented by the smallest-hashed 24-byte string in it, its anchor, which equal windows share. The
windows with one anchor are a unit; its context is the text they cover.

1. Signatures: tasks group their units by anchor hash. Anchors met twice or more survive. Units
   that share an anchor within a task survive at once, and one of them stands for all.
2. Runs: documents with surviving units cut the contexts as suffixes that begin at the anchor. Suffixes
   are sorted and front-coded (length shared with the one before, and the rest); one that shares its
   whole length with its neighbour is removed whole. Runs are dealt by anchor.
3. Merge: each bucket's runs go through a loser tree whose nodes remember the prefix they share with
   the last winner, so no known prefix is compared again. The shared prefixes of sorted neighbours
   decide: the whole length is an equal context; less than an anchor ends a group; and for windows that
   begin some bytes before the anchor, neighbours that share the window's other bytes form the blocks in
   which those few bytes before it are sorted and compared.
4. Removed intervals return to their documents.

Equality is decided on text; hashes only choose what to compare. Tasks hold a run of RUN_BYTES of text
or one document. Documents are shuffled once, used twice. Hot groups: a group holds different contexts
of one anchor, and of an anchor with more units than `hot_units` (or a millionth of the bytes) each
window is a suffix of its own, dealt by its whole text: equal ones leave their run as one, so neither a
common line in ever new surroundings nor a common passage meets in one task. At most two million such
anchors exist, whatever the input; their hashes are broadcast.

Defined results: a null text is empty; texts under 100 bytes are never cut; equal rows of one doc_id are
one document, whose result is given for each of them; rows of a doc_id with different texts have no
order, so they are returned uncut and cut nothing, and so are rows of a null id; an empty table gives no
rows; extra columns are ignored; the first of equal texts stays whole; texts of any length are read
whole, in blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import mix64, staged

WINDOW = 100
ANCHOR = 24
RUN_BYTES = 12_000_000
#: Bytes of input for each bucket of signatures and of runs.
BUCKET_BYTES = 4_000_000
#: Units beyond which an anchor's windows are dealt one by one.
HOT_UNITS = 100_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_PLACE_BITS = 24
_BLOCK = 1 << 20
_SIG = np.dtype([("key", "<u8"), ("doc", "<i8"), ("p", "<u4"), ("n", "u1"), ("off", "u1"), ("known", "u1")])
_LOC = np.dtype([("p", "<u4"), ("n", "u1"), ("off", "u1")])
_MARK = np.dtype([("begin", "<u4"), ("end", "<u4")])
_ITEM = np.dtype([("doc", "<i8"), ("p", "<u4"), ("shared", "u1"), ("rest", "u1")])
#: A name's last byte: the anchor's place after its context's begin, or this for a window that is a suffix of its own.
_ALONE = 255


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK + WINDOW), _powers(_INVERSE, _BLOCK + WINDOW)


def units(raw: bytes) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, number of windows, anchor's place after the first window's start) of each unit.

    Long texts are taken in overlapping blocks that hold each window once; a unit cut by a block's edge is
    two units of different windows, which changes nothing but their number.
    """
    parts = []
    for at in range(0, max(1, len(raw) - WINDOW + 1), _BLOCK - WINDOW + 1):
        b = np.frombuffer(raw, dtype=np.uint8, count=min(_BLOCK, len(raw) - at), offset=at).astype(np.uint64) + _U(1)
        if len(b) < WINDOW:
            continue
        h = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(b * _UP[: len(b)], dtype=np.uint64)])
        key = mix64((h[ANCHOR:] - h[:-ANCHOR]) * _DOWN[: len(b) - ANCHOR + 1])
        low = _U((1 << _PLACE_BITS) - 1)
        v = (key & ~low) | np.arange(len(key), dtype=np.uint64)  # ties go to the first place
        width, m, span = WINDOW - ANCHOR + 1, v, 1
        while span * 2 <= width:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        n = len(b) - WINDOW + 1
        m = np.minimum(m[:n], m[width - span : width - span + n])
        place = (m & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([first, [n]]))
        parts.append((key[place[first]], first + at, count, place[first] - first))
    if not parts:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _planes(rows: np.ndarray) -> bytes:
    """Records as one row of bytes for each byte of a record: what hardly changes from record to record then compresses well."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), -1).T).tobytes()


def _records(data, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of the batches, cut into runs of RUN_BYTES of text."""
    run, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            run.append(row)
            size += len(row[1] or "")
            if size >= RUN_BYTES:
                yield run
                run, size = [], 0
    if run:
        yield run


def _signatures(buckets: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            found = []
            for doc, text in run:
                key, p, n, off = units((text or "").encode())
                s = np.zeros(len(key), dtype=_SIG)
                s["key"], s["doc"], s["p"], s["n"], s["off"] = key, doc, p, n, off
                found.append(s)
            s = np.concatenate(found)
            if not len(s):
                continue
            s = s[np.argsort(s["key"], kind="stable")]
            first = np.flatnonzero(np.concatenate([[True], s["key"][1:] != s["key"][:-1]]))
            size = np.diff(np.concatenate([first, [len(s)]]))
            # 1: survives already and is only passed on; 2 + k: survives and stands for 2^k to 2^(k + 1) units of its anchor here
            s["known"] = 1
            s["known"][first] = np.where(size == 1, 0, 2 + np.log2(size).astype(int))
            bucket = np.where(s["known"] == 1, mix64(s["doc"].astype(np.uint64)), s["key"]) % _U(buckets)
            order = np.lexsort((s["p"], s["doc"], bucket))
            s, bucket = s[order], bucket[order].astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut[:-1]]), pa.array([_planes(s[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
                names=["bucket", "data"],
            )

    return make


def _by_doc(doc: np.ndarray, rows: np.ndarray) -> pa.Table:
    order = np.argsort(doc, kind="stable")
    doc, rows = doc[order], rows[order]
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else np.zeros(1, dtype=int)
    return pa.table({"doc": pa.array(doc[cut[:-1]], pa.int64()), "data": pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def _surviving(hot_units: int):
    def make(group: pa.Table) -> pa.Table:
        """Places of the surviving units by document, and under a null document the anchors with too many units."""
        s = np.concatenate([_records(x.as_buffer(), _SIG) for x in group.column("data")])
        passed, s = s[s["known"] == 1], s[s["known"] != 1]
        s = s[np.argsort(s["key"], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], s["key"][1:] != s["key"][:-1]])) if len(s) else np.empty(0, dtype=int)
        met = np.diff(np.concatenate([first, [len(s)]])) > 1
        stands = np.where(s["known"] == 0, 1, 1 << np.maximum(s["known"].astype(np.int64) - 1, 0))
        hot = s["key"][first][np.add.reduceat(stands, first) > hot_units] if len(s) else s["key"]
        s = np.concatenate([passed, s[np.repeat(met, np.diff(np.concatenate([first, [len(s)]]))) | (s["known"] > 1)]])
        loc = np.empty(len(s), dtype=_LOC)
        for c in ("p", "n", "off"):
            loc[c] = s[c]
        out = _by_doc(s["doc"], loc)
        return pa.concat_tables([out, pa.table([pa.nulls(1, pa.int64()), pa.array([hot.tobytes()], pa.binary())], schema=out.schema)]) if len(hot) else out

    return make


def anchor_keys(raw: bytes, places: np.ndarray) -> np.ndarray:
    """The hashes of the anchors at these places, as `units` gives them."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64) + _U(1)
    return mix64((b[places[:, None] + np.arange(ANCHOR)] * _UP[:ANCHOR]).sum(1, dtype=np.uint64))


def shared_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be at least `at`."""
    end = min(len(a), len(b))
    while at < end and a[at : at + 16] == b[at : at + 16]:
        at += 16
    while at < end and a[at] == b[at]:
        at += 1
    return min(at, end)


def _names(doc: int, raw: bytes, data: list[bytes], hot: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    """(name, doc, first byte) of each suffix: the text from the anchor on, then what precedes it in the context, and where that begins."""
    loc = np.frombuffer(b"".join(data), dtype=_LOC)
    alone = np.isin(anchor_keys(raw, loc["p"].astype(np.int64) + loc["off"]), hot).tolist() if len(hot) else [False] * len(loc)
    for (p, n, off), every in zip(loc.tolist(), alone, strict=True):
        if every:
            for at in range(p, p + n):
                yield raw[at : at + WINDOW] + bytes((_ALONE,)), doc, at
        else:
            here, end = p + off, p + n + WINDOW - 1
            yield raw[here:end] + raw[p:here] + bytes((off,)), doc, p


def _sorted_runs(buckets: int, held):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = held.value
        for run in _runs(batches):
            names = sorted(x for doc, text, data in run for x in _names(doc, (text or "").encode(), data, hot))
            removed: dict[int, list[tuple[int, int]]] = {}
            parts: dict[int, tuple[list, list, bytes]] = {}
            last: tuple[bytes, int, int] = (b"", -1, -1)
            for name, doc, p in names:  # the earliest of equal names comes first
                if name == last[0]:
                    if (doc, p) != last[1:]:
                        removed.setdefault(doc, []).append((p, p + len(name) - 1))
                    continue
                last = name, doc, p
                bucket = zlib.crc32(name if name[-1] == _ALONE else name[:ANCHOR]) % buckets
                items, rest, before = parts.get(bucket) or ([], [], b"")
                k = shared_prefix(before, name)
                items.append((doc, p, k, len(name) - k))
                rest.append(name[k:])
                parts[bucket] = items, rest, name
            ids = list(parts)
            data = [write_run(items, rest) for items, rest, _ in parts.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.nulls(len(ids), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "doc", "data"]
            )
            docs = list(removed)
            yield pa.RecordBatch.from_arrays(  # only passed on
                [pa.array([x % buckets for x in docs], pa.int64()), pa.array(docs, pa.int64()), pa.array([np.array(removed[x], dtype=_MARK).tobytes() for x in docs], pa.binary())],
                names=["bucket", "doc", "data"],
            )

    return make


def write_run(items: list[tuple[int, int, int, int]], rest: list[bytes]) -> bytes:
    """A front-coded run: (doc, p, shared prefix, length of the rest) of each name, then what they don't share, compressed."""
    raw = _planes(np.array(items, dtype=_ITEM)) + b"".join(rest)
    return len(items).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def read_run(data: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """(name, shared prefix with the one before, doc, p) of a front-coded run."""
    n, size = (int.from_bytes(data[i : i + 4], "little") for i in (0, 4))
    raw = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
    at, before = n * _ITEM.itemsize, b""
    for doc, p, shared, rest in _records(raw[:at], _ITEM).tolist():
        before = before[:shared] + raw[at : at + rest]
        at += rest
        yield before, shared, doc, p


def merge(runs: list[Iterator[tuple[bytes, int, int, int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Sorted runs merged by a loser tree over common prefixes; gives each name's shared prefix with the one before."""
    k = 1
    while k < len(runs):
        k *= 2
    head: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [x[1] if x else 0 for x in head]  # with the last winner

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser keeps the prefix it shares with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:  # the longer prefix of the last winner is the smaller name
            return (a, b) if shared[a] > shared[b] else (b, a)
        s, t = x[0], y[0]
        h = shared_prefix(s, t, shared[a])
        if (s[h : h + 1], a) <= (t[h : h + 1], b):
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    loser = [0] * k
    level = list(range(k))
    base = k
    while base > 1:
        up = []
        for i in range(0, base, 2):
            w, lost = play(level[i], level[i + 1])
            loser[(base + i) // 2] = lost
            up.append(w)
        level, base = up, base // 2
    top = level[0]
    while head[top] is not None:
        name, _, doc, p = head[top]
        yield name, shared[top], doc, p
        head[top] = next(runs[top], None)
        shared[top] = head[top][1] if head[top] else 0
        node, w = (k + top) // 2, top
        while node >= 1:
            w, loser[node] = play(w, loser[node])
            node //= 2
        top = w


def _resolve(members: list[tuple[int, int, bytes, int]], mark) -> None:
    """Marks windows that repeat an earlier one of the group.

    members: (doc, first byte, name, prefix shared with the member before) of one anchor, in order of
    names, all different. Equal windows hold the anchor at one place, so they share the WINDOW - place
    bytes from it on, which their neighbours' prefixes tell, and the place bytes before it.
    """
    if len(members) < 2:
        return
    longest = max(x[3] for x in members[1:])
    held = [(doc, p, name[-1], len(name) - 1 - name[-1], name, shared) for doc, p, name, shared in members]

    def settle(block: list[tuple[bytes, int, int]]) -> None:
        block.sort()
        for x, y in zip(block, block[1:], strict=False):
            if x[0] == y[0] and x[1:] != y[1:]:
                mark(y[1], y[2], y[2] + WINDOW)

    for place in range(max(0, WINDOW - longest), max(x[2] for x in held) + 1):
        need, block = WINDOW - place, []
        for doc, p, off, right, name, shared in held:
            if shared < need:
                if len(block) > 1:
                    settle(block)
                block = []
            if need <= right and place <= off:  # the context holds such a window
                block.append((name[right + off - place : -1], doc, p + off - place))
        if len(block) > 1:
            settle(block)


def _merged(group: pa.Table) -> pa.Table:
    docs, marks, runs = [], [], []
    for doc, data in zip(group.column("doc").to_pylist(), group.column("data").to_pylist(), strict=True):
        if doc is None:
            runs.append(read_run(data))
        else:
            got = np.frombuffer(data, dtype=_MARK)
            docs.append(np.full(len(got), doc))
            marks.append(got)
    new: list[tuple[int, int, int]] = []
    mark = lambda doc, a, b: new.append((doc, a, b))
    members: list[tuple[int, int, bytes, int]] = []
    last, at, low = b"", (-1, -1), 0  # the last name, its earliest place, the prefix shared since the last member

    def take() -> None:
        nonlocal members, low
        if last and last[-1] != _ALONE:
            members.append((*at, last, low))
            low = len(last)

    for name, shared, doc, p in merge(runs) if runs else ():
        if shared == len(name) == len(last):
            here = max(at, (doc, p))
            if at != (doc, p):
                mark(*here, here[1] + len(name) - 1)
            at = min(at, (doc, p))
            continue
        take()
        low = min(low, shared)
        if shared < ANCHOR:
            _resolve(members, mark)
            members = []
        last, at = name, (doc, p)
    take()
    _resolve(members, mark)
    own = np.empty(len(new), dtype=_MARK)
    if new:
        d, own["begin"], own["end"] = zip(*new, strict=True)
        docs.append(np.array(d))
    marks.append(own)
    return _by_doc(np.concatenate(docs) if docs else np.empty(0, dtype=np.int64), np.concatenate(marks))


def removed_mask(size: int, marks: list[bytes]) -> np.ndarray:
    """Whether each byte is removed."""
    step = np.zeros(size + 1, dtype=np.int64)
    got = np.frombuffer(b"".join(marks), dtype=_MARK)
    np.add.at(step, got["begin"], 1)
    np.add.at(step, got["end"], -1)
    return np.cumsum(step[:-1]) > 0


def _cut(with_text: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                mask = removed_mask(len(raw), data or [])
                left = np.frombuffer(raw, dtype=np.uint8)[~mask].tobytes() if data else raw
                spans = int((np.diff(np.concatenate([[False], mask]).astype(np.int8)) == 1).sum())
                row = (doc, len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]
            n = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], kinds, strict=False)], names=names[:n])

    return make


def dedup(docs: DataFrame, with_text: bool = False, hot_units: int = HOT_UNITS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs, and the bytes kept if asked."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    told = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = d.select("doc_id", told.alias("h"), F.octet_length("text").alias("n")).where("doc_id is not null")
    rows = staged(rows.groupBy("doc_id").agg((F.min("h") != F.max("h")).alias("differ"), F.sum("n").alias("n")), "sizes")
    unclear = rows.where("differ").select("doc_id")
    size = int(rows.agg(F.sum("n")).first()[0] or 0)
    buckets = max(32, size // BUCKET_BYTES)
    # a key that is never null and no hot one keeps both joins' shuffles of the texts alike, so that one is made and reused
    d = d.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    whole = d.select("doc_id", "text").where("doc_id is not null and octet_length(text) >= 100")
    if unclear.head(1):  # a doc_id with different texts
        whole = whole.join(unclear, "doc_id", "left_anti")
    signatures = whole.mapInArrow(_signatures(buckets), "bucket long, data binary")
    alive = staged(signatures.groupBy("bucket").applyInArrow(_surviving(max(hot_units, size // 1_000_000)), "doc long, data binary"), "alive")
    hot = [r["data"] for r in alive.where("doc is null").select("data").collect()]  # two million hashes at most
    held = docs.sparkSession.sparkContext.broadcast(np.frombuffer(b"".join(hot), dtype="<u8"))
    alive = alive.where("doc is not null").groupBy("doc").agg(F.collect_list("data").alias("data"))
    cut = d.where("doc_id is not null").join(alive, F.col("key") == F.col("doc")).select("doc_id", "text", "data")
    runs = cut.mapInArrow(_sorted_runs(buckets, held), "bucket long, doc long, data binary")
    marks = runs.groupBy("bucket").applyInArrow(_merged, "doc long, data binary")
    marks = marks.groupBy("doc").agg(F.collect_list("data").alias("data"))
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_text else "")
    found = d.join(marks, F.col("key") == F.col("doc"), "left")
    return found.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.col("data")).alias("data")).mapInArrow(_cut(with_text), out)

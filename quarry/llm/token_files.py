"""Token-id files: blocks of ids, each coded by a range coder under an adaptive mix of order-0, -1 and -2 predictions.

A file holds blocks, then an index of its documents (id, tokens) and a footer. A block starts from a fresh model and has
its own checksum, so that any block can be decoded alone. Many blocks are coded side by side, one numpy lane each.

The model of a block, over the ids that occur in it (its alphabet, stored in its head):
- order 2 predicts the id that last followed the same two ids, order 1 the one that last followed the same id; each
  prediction has a run length of successes, and the hit rate seen so far at that run length is its weight;
- order 0 counts ids; its cumulative counts are renewed at fixed places, which lie closer at a block's start;
- the weights mix the three into one distribution: order 2's share of it stands first, order 1's next, order 0's last.
  Where orders 2 and 1 name the same id, it has both shares. An id is coded in the first share that names it. The
  distribution drives a 48-bit range coder with 16-bit output, whose carries are settled when a block ends.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, open_file, partitions, write_file
from .tokens import encoder, tokenizer_path

MAGIC = b"QIDS0002"
HEAD = "<IIIII"  # ids, alphabet's size, bytes of alphabet, bytes of code, crc32 of both
FOOT = "<QQQI8s"  # index's offset and length, blocks, crc32 of the index, magic
BLOCK = 2048
LANES = 4096
#: Places in a block at which order 0's cumulative counts are renewed.
RENEW = frozenset((32, 64, 128, 192, 256, 384, 512, 768, 1024, 1536))
SLOTS = 1024
#: Lanes whose ids are turned into columns, or back, at once.
TURN = 64
#: Every so many cumulative counts one stands in a small table, where looking for a count begins.
COARSE = 32
RUNS = 8
#: Where all ids are below this, a table tells their places in the alphabet.
TABLED = 1 << 18
#: Words of one generation of the memory that encodes texts: what is made again costs more here than the memory does.
MEMO_WORDS = 480_000
MIX_BITS = 22
GAIN = 24
WHOLE = 1 << MIX_BITS
#: The coder's range stays between TOP and FULL. An id takes at most 20 bits, as order 0 keeps a 16th of the whole.
TOP, FULL = 2.0**32, 2.0**48 - 1


class _Model:
    """The state of some lanes; ids are places in each block's alphabet.

    Arrays of two rows are of order 1, then of order 2; what is done to both is done once. Arrays of one kind meet each
    other without conversions, which cost numpy more than the sums themselves. Counts stay below 2**16: BLOCK * GAIN, and
    one for each id. Places are always within their arrays, so that looking them up need not check it (mode="clip"). seen
    holds a predicted place times RUNS, and its run.
    """

    def __init__(self, sizes: np.ndarray):
        n = len(sizes)
        self.wide = 1 << int(sizes.max()).bit_length()
        row = np.arange(n, dtype=np.int64)
        self.at0, self.base = row * self.wide, np.stack([row * self.wide, n * self.wide + row * SLOTS])
        self.at_run = np.arange(2 * n).reshape(2, n) * RUNS
        self.count = (np.arange(self.wide)[None] < sizes[:, None]).astype(np.uint16)
        self.cum = np.zeros((n, self.wide), np.uint16)
        self.seen = np.full(n * (self.wide + SLOTS), -RUNS, np.int16)
        # Run 0 stands for no prediction; its rate stays 0.
        rates = lambda a, b: np.tile(np.concatenate([[0], np.linspace(a, b, RUNS - 1)]).astype(np.int32), n)
        self.rate = np.concatenate([rates(6000, 48000), rates(9000, 56000)])
        # The last id, and what the next one's place in seen hangs on in order 2. Sums are modulo 2**16.
        self.last, self.x2 = np.zeros((2, n), np.uint16), np.zeros(n, np.uint16)
        self.renew()

    def narrow(self, k: int) -> None:
        """Goes on with the first k lanes."""
        for name in ("at0", "base", "at_run", "last", "x2", "total"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[..., :k]))

    def renew(self, ids: np.ndarray | None = None) -> None:
        """Takes in the ids since the last time, a row for each step."""
        if ids is not None:
            np.add.at(self.count.ravel(), (ids + self.at0).ravel(), np.uint16(GAIN))
        k = len(self.at0)
        np.cumsum(self.count[:k, :-1], axis=1, dtype=np.uint16, out=self.cum[:k, 1:])
        self.flat, self.total = self.cum.ravel(), self.cum[:k, -1].astype(np.float64)
        self.coarse = self.cum[:k, ::COARSE].ravel()

    def predict(self) -> None:
        """Predictions, and the shares w of orders 1 and 2; the rest of WHOLE is order 0's, `each` for each count."""
        h = np.multiply(self.last[0], ORDER2, out=self.last[1])
        h += self.x2
        h >>= THREE
        h &= SLOT
        self.i = self.last.astype(np.int64)
        self.i += self.base
        seen = self.seen.take(self.i, mode="clip")
        self.p, self.run = seen >> THREE_, seen & SEVEN
        self.j = self.run.astype(np.int64)
        self.j += self.at_run
        self.old = self.rate.take(self.j, mode="clip")
        w = np.empty_like(self.old)
        w1, w2 = w
        np.multiply(self.old[1], (WHOLE - (WHOLE >> 3)) >> 16, out=w2)
        np.subtract(WHOLE - (WHOLE >> 4), w2, out=w1)
        w1 >>= 4
        w1 *= self.old[0] >> 4
        w1 >>= 8
        self.w, self.past = w, w1 + w2
        both = (self.p[0] == self.p[1]).astype(np.int32)
        both *= w1
        w2 += both
        w1 -= both
        self.each = ((WHOLE - self.past) / self.total).astype(np.int32)

    def order0(self, at: np.ndarray, each: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width in order 0's share. at: the ids' places in flat."""
        start, width = self.flat.take(at, mode="clip").astype(np.int32), self.flat.take(at + 1, mode="clip").astype(np.int32)
        width -= start
        width *= each
        start *= each
        start += past
        return start, width

    def last_below(self, most: np.ndarray, base: np.ndarray) -> np.ndarray:
        """For some lanes, by where they begin in flat: where the last cumulative count stands that is not above most."""
        each = max(1, self.wide // COARSE)
        c = base // self.wide * each
        for half in _halves(each):
            up = (self.coarse.take(c + half, mode="clip") <= most).astype(np.int64)
            up *= half
            c += up
        a = c * min(COARSE, self.wide)
        for half in _halves(min(COARSE, self.wide)):
            up = (self.flat.take(a + half, mode="clip") <= most).astype(np.int64)
            up *= half
            a += up
        return a

    def learn(self, x: np.ndarray, hit: np.ndarray) -> None:
        """hit: which orders predicted x."""
        run = np.minimum(self.run, MOST, out=self.run)
        run *= hit.astype(np.int16)
        fresh = x << THREE_
        fresh += ONE
        run += fresh
        self.seen[self.i.reshape(-1)] = run.reshape(-1)
        new = hit.astype(np.int32)
        new *= 65000
        new -= self.old
        new >>= 5
        new += self.old
        self.rate[self.j.reshape(-1)] = new.reshape(-1)
        np.multiply(self.last[0], ORDER2_BEFORE, out=self.x2)
        self.last[0] = x


def _halves(n: int) -> list[int]:
    """n / 2, n / 4, ..., 1, for a power of two."""
    return [n >> k for k in range(1, n.bit_length())]


#: Numbers as arrays: numpy takes longer to turn them into such than to sum some lanes.
ORDER2, ORDER2_BEFORE, THREE, SLOT = np.array([2654435 % (1 << 16), 40503, 3, SLOTS - 1], np.uint16)[:, None]
THREE_, SEVEN, MOST, ONE = np.array([3, RUNS - 1, RUNS - 2, 1], np.int16)[:, None]

assert RUNS == 8 and BLOCK * RUNS < 1 << 15 and BLOCK * (GAIN + 1) < 1 << 16


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block's head and bytes. blocks: 1 to BLOCK ids each."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    out: list = [None] * len(blocks)
    for g in range(0, len(order), LANES):
        own = order[g : g + LANES]
        n, lens = len(own), np.array([len(blocks[i]) for i in own])
        # Lanes are turned into columns some at a time, so that what is read and what is written stays near.
        alphabets, places, xt = [], np.zeros((TURN, lens[0]), np.int16), np.zeros((lens[0], n), np.int16)
        most = max(int(blocks[i].max()) for i in own) + 1
        where = np.zeros(most, np.int16) if most <= TABLED else None
        for r, i in enumerate(own):
            x = np.sort(blocks[i])
            alphabet = x[np.concatenate([[True], x[1:] != x[:-1]])]
            if where is None:
                places[r % TURN, : lens[r]] = np.searchsorted(alphabet, blocks[i])
            else:
                where[alphabet] = np.arange(len(alphabet))
                places[r % TURN, : lens[r]] = where[blocks[i]]
            alphabets.append(alphabet)
            if r % TURN == TURN - 1 or r == n - 1:
                xt[:, r - r % TURN : r + 1] = places[: r % TURN + 1].T
        m = _Model(np.array([len(a) for a in alphabets]))
        low, rng = np.zeros(n), np.full(n, FULL)
        # A row holds a word of every lane; bit 16 of a word is a carry into the one before.
        words, at = np.zeros((int(lens[0]) * 21 // 16 + 8) * n, np.uint32), np.arange(n, dtype=np.int64)
        k, last = n, 0
        for t in range(lens[0]):
            if lens[k - 1] <= t:
                k = int((lens > t).sum())
                m.narrow(k)
            if t in RENEW:
                m.renew(xt[last:t, :k])
                last = t
            m.predict()
            x = xt[t, :k]
            start, width = m.order0(m.at0 + x, m.each, m.past)
            # By sums rather than by choices, which cost several times as much. An id in both shares has no share w1, so
            # it is in one of them only. A share of 0 hits nothing.
            hit = m.p == x
            on = hit & (m.w > 0)
            miss, on = (~(on[0] | on[1])).astype(np.int32), on.astype(np.int32)
            start *= miss
            start += m.w[1] * on[0]
            width *= miss
            on *= m.w
            width += on[0]
            width += on[1]
            r = np.floor(rng[:k] * 2.0**-MIX_BITS)
            low[:k] += r * start.astype(np.float64)
            r *= width.astype(np.float64)
            less = r < TOP
            word = np.floor(low[:k] * 2.0**-32)
            words[at[:k]] = word.astype(np.uint32)
            at[:k] += less.astype(np.int64) * n
            by = less.astype(np.float64)
            word *= by
            word *= TOP
            low[:k] -= word
            by *= 65535
            by += 1
            low[:k] *= by
            r *= by
            # Few lanes have a second word to give.
            more = (r < TOP).nonzero()[0]
            while len(more):
                word = np.floor(low[more] * 2.0**-32)
                words[at[more]] = word.astype(np.uint32)
                at[more] += n
                low[more] = (low[more] - word * TOP) * 65536
                r[more] *= 65536
                more = more[r[more] < TOP]
            rng[:k] = r
            m.learn(x, hit)
        for _ in range(3):
            word = np.floor(low * 2.0**-32)
            words[at] = word.astype(np.uint32)
            at += n
            low = (low - word * TOP) * 65536
        rows, used = words.reshape(-1, n), at // n
        for j in range(int(used.max()) - 1, 0, -1):
            rows[j] *= used > j
            rows[j - 1] += rows[j] >> 16
        codes = np.ascontiguousarray(rows[: int(used.max())].astype("<u2").T)
        for r, i in enumerate(own):
            gaps = alphabets[r].copy()
            gaps[1:] -= alphabets[r][:-1]
            # A window no wider than most alphabets: a wide one takes longer to make than to fill. Gaps seldom recur in
            # longer runs, so that looking for these costs time and gains nothing.
            z = zlib.compressobj(1, zlib.DEFLATED, 11, 4, zlib.Z_RLE)
            head = z.compress(gaps.astype("<u2" if int(gaps.max()) < 1 << 16 else "<u4").tobytes()) + z.flush()
            code = codes[r, : used[r]].tobytes()
            out[i] = struct.pack(HEAD, lens[r], len(alphabets[r]), len(head), len(code), zlib.crc32(code, zlib.crc32(head))) + head + code
    return out


def decode_blocks(parts: list[tuple[int, int, bytes, bytes]]) -> list[np.ndarray]:
    """parts: (ids, alphabet's size, alphabet, code) of each block."""
    order = sorted(range(len(parts)), key=lambda i: -parts[i][0])
    out: list = [None] * len(parts)
    for g in range(0, len(order), LANES):
        own = order[g : g + LANES]
        n, lens = len(own), np.array([parts[i][0] for i in own])
        heads = [zlib.decompress(parts[i][2]) for i in own]
        alphabets = [np.cumsum(np.frombuffer(h, "<u2" if len(h) == 2 * parts[i][1] else "<u4"), dtype=np.int64) for i, h in zip(own, heads)]
        codes = [np.frombuffer(parts[i][3], "<u2") for i in own]
        room = max(map(len, codes)) + 8
        words = np.zeros((n, room), np.uint16)
        for r, c in enumerate(codes):
            words[r, : len(c)] = c
        words = words.ravel()
        m = _Model(np.array([len(a) for a in alphabets]))
        at = np.arange(n, dtype=np.int64) * room
        # What the code lies above the range's low end.
        above, rng = words[at] * TOP + words[at + 1] * 65536.0 + words[at + 2], np.full(n, FULL)
        at += 3
        xt = np.zeros((lens[0], n), np.int16)
        k, last = n, 0
        for t in range(lens[0]):
            if lens[k - 1] <= t:
                k = int((lens > t).sum())
                m.narrow(k)
            if t in RENEW:
                m.renew(xt[last:t, :k])
                last = t
            m.predict()
            r = np.floor(rng[:k] * 2.0**-MIX_BITS)
            v = (above[:k] / r).astype(np.int32)
            w1, w2 = m.w
            hit2 = v < w2
            one = hit2.astype(np.int32)
            width = w2 - w1
            width *= one
            width += w1
            p1, p2 = m.p
            x = p2 - p1
            x *= hit2.astype(np.int16)
            x += p1
            start = one ^ 1
            start *= w2
            # Order 0: the last place whose cumulative count is not above what v says.
            q = (v >= m.past).nonzero()[0]
            past, each, base = m.past.take(q, mode="clip"), m.each.take(q, mode="clip"), m.at0.take(q, mode="clip")
            most = ((v.take(q, mode="clip") - past) / each).astype(np.uint16)
            a = m.last_below(most, base)
            start[q], width[q] = m.order0(a, each, past)
            x[q] = a - base
            xt[t, :k] = x
            above[:k] -= r * start.astype(np.float64)
            r *= width.astype(np.float64)
            less = r < TOP
            word = words.take(at[:k], mode="clip")
            at[:k] += less.astype(np.int64)
            by = less.astype(np.float64)
            word = word * by
            by *= 65535
            by += 1
            r *= by
            above[:k] *= by
            above[:k] += word
            more = (r < TOP).nonzero()[0]
            while len(more):
                above[more] = above[more] * 65536 + words[at[more]]
                at[more] += 1
                r[more] *= 65536
                more = more[r[more] < TOP]
            rng[:k] = r
            m.learn(x, m.p == x)
        for g in range(0, n, TURN):
            for r, places in enumerate(np.ascontiguousarray(xt[:, g : g + TURN].T), g):
                out[own[r]] = alphabets[r].take(places[: lens[r]]).astype(np.uint32)
    return out


def file_chunks(ids: Iterator[np.ndarray], docs: pa.Table) -> Iterator[bytes]:
    """A file's bytes. ids: the ids in order, in pieces of any size, taken as they are needed; docs: made by then."""
    at, n_blocks, held, have = len(MAGIC), 0, [], 0
    yield MAGIC

    def blocks(final: bool):
        nonlocal held, have
        whole = np.concatenate(held) if held else np.zeros(0, np.uint32)
        end = len(whole) if final else len(whole) // BLOCK * BLOCK
        held, have = [whole[end:]], len(whole) - end
        return encode_blocks([whole[i : min(i + BLOCK, end)] for i in range(0, end, BLOCK)])

    for x in ids:
        held.append(x)
        have += len(x)
        if have >= BLOCK * LANES:
            for b in blocks(False):
                at, n_blocks = at + len(b), n_blocks + 1
                yield b
    for b in blocks(True):
        at, n_blocks = at + len(b), n_blocks + 1
        yield b
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, (table := docs() if callable(docs) else docs).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    yield sink.getvalue()
    yield struct.pack(FOOT, at, len(sink.getvalue()), n_blocks, zlib.crc32(sink.getvalue()), MAGIC)


def read_file(uri: str) -> Iterator[tuple[pa.Table, np.ndarray | None]]:
    """First (the index of documents, None), then (the same, ids) in order, some blocks at a time."""
    with open_file(uri) as f:
        f.seek(0, 2)
        f.seek((f.tell()) - struct.calcsize(FOOT))
        at, size, n_blocks, crc, magic = struct.unpack(FOOT, f.read(struct.calcsize(FOOT)))
        f.seek(at)
        raw = f.read(size)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError(f"{uri}: no whole token file")
        docs = pa.ipc.open_stream(raw).read_all()
        yield docs, None
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri}: no token file")
        for g in range(0, n_blocks, LANES):
            parts = []
            for _ in range(min(LANES, n_blocks - g)):
                n, a, na, nc, crc = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
                head, code = f.read(na), f.read(nc)
                if zlib.crc32(code, zlib.crc32(head)) != crc:
                    raise ValueError(f"{uri}: a block's checksum is wrong")
                parts.append((n, a, head, code))
            yield docs, np.concatenate(decode_blocks(parts))


def write_token_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Writes the ids of every whole text, in ascending order of key (nulls first), one file for each range of keys.

    Returns one row for each file: part, path, n_docs, n_ids, n_bytes. end_id follows each document's ids. A null text is
    empty. A task that runs again writes a file of another name; only files of this table count. Run it once: keep it.
    """
    path, n = tokenizer or tokenizer_path(), partitions(docs.sparkSession)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        import uuid

        from pyspark import TaskContext

        keys, lens = [], []
        enc = encoder(path)
        enc.memo.most = MEMO_WORDS

        def ids():
            for b in batches:
                keys.append(b.column(0))
                for x in enc.ids(b.column(1).to_pylist()):
                    lens.append(len(x + end) // 4)
                    yield np.frombuffer(x + end, np.uint32)

        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        size = write_file(uri, file_chunks(ids(), lambda: pa.table({"key": pa.chunked_array(keys) if keys else pa.array([], pa.int64()), "n": pa.array(lens, pa.int64())})))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [uri], "n_docs": pa.array([len(lens)], pa.int64()), "n_ids": pa.array([sum(lens)], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(write, "part int, path string, n_docs long, n_ids long, n_bytes long")


def read_documents(files: DataFrame, key_type: str = "bigint") -> DataFrame:
    """From files of write_token_files, per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    n = partitions(files.sparkSession)
    base = files.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches):
        for b in batches:
            for uri, before in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                crcs: list[int] = []
                lens = None
                rest = np.zeros(0, np.uint32)
                for docs, ids in read_file(uri):
                    if lens is None:
                        lens = docs["n"].to_pylist()
                    if ids is None:
                        continue
                    rest, at = np.concatenate([rest, ids]), 0
                    while len(crcs) < len(lens) and at + lens[len(crcs)] <= len(rest):
                        e = at + lens[len(crcs)]
                        crcs.append(zlib.crc32(rest[at:e].astype("<u4").tobytes()))
                        at = e
                    rest = rest[at:]
                while len(crcs) < len(lens) and lens[len(crcs)] == 0:
                    crcs.append(0)
                if len(crcs) != len(lens) or len(rest):
                    raise ValueError(f"{uri}: ids and index differ")
                size = np.array(lens, np.int64)
                table = pa.table({"doc_id": docs["key"], "start": before + np.cumsum(size) - size, "n_tokens": size, "ids_crc32": pa.array(crcs, pa.int64())})
                yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return base.repartitionByRange(n, "part").mapInArrow(read, f"doc_id {key_type}, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the end id 2, written in ascending order of doc_id and read back.

    Null texts are empty (the end id alone); repeated doc_ids come next to each other in any order; an empty table gives
    no rows. Rows: doc_id, start, n_tokens, ids_crc32.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark, "op1")
    with arrow_rows(spark):
        files = scratch.table(write_token_files(docs, scratch.path("ids")), "files")
    return read_documents(files.where("n_docs > 0"))

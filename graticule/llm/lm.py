"""Language-model scores of whole texts.

A text is its words (A-Z lower-cased) and one end.  Two models score it.  The base is an additively smoothed count
of words.  The model is causal self-attention over the words' subword ids (see `attention`): softmaxes over all words, weighted by
what came before.  A word that no training text holds is the event of a new word, which the softmaxes know, and is then spelled by
pairs of subwords.

1. Texts become blocks: word numbers, and for each distinct word its hash, its training count and its subwords.
   Blocks are a written table; texts are read once.
2. Each block asks for the training counts of its words: hashes and counts go to buckets by hash, are
   summed there, and go back.  Words are told apart by 64-bit hashes.
3. Spelling counts are summed over the rare words of all training texts.
4. Weights are fitted by every window of every training text, in rounds: tasks take steps of their own over a share of the windows of
   their blocks, and their weights are averaged, a subword's rows by how often each task met it.  Tables of fewer than `least_windows` windows are gone
   through several times.  Then the softmaxes' normalisers are summed over all training words.
5. Blocks meet their counts and are scored in overlapping windows.

Edge cases: null and empty texts are one end; words of any length are scored whole; repeated rows are scored alike and all count; rows without an id are
training texts; without training texts counts are 0 and the model is flat; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .attention import Adam, Attention, Lexicon

#: A public byte-pair vocabulary (text lines: base64 piece, rank); a file that the driver reads.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that vocabulary cuts text into pieces before merging (fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text in a block, and words asked for in a bucket.
BLOCK_BYTES, BUCKET_WORDS = 6 << 20, 1_000_000
#: Blocks that one task trains on.
TASK_BLOCKS = 8
#: Places of each of the two tables that pairs of subwords are counted in.
SLOTS = 1 << 18
#: Shares of the windows that the rounds of training take, and their rates.
ROUNDS = ((1 / 8, 0.02), (3 / 8, 0.02), (1 / 2, 0.01))
#: Windows that stay together when a block's are shuffled.
RUN = 8
#: Words that a block's training texts hold at most so often tell how words are spelled.
RARE = 3


class Subwords:
    """Subword ids of words by a public tokenizer; the end has the first id after its vocabulary."""

    def __init__(self, lines: bytes):
        self.lines, self._made = lines, None

    def __getstate__(self):
        return {"lines": self.lines, "_made": None}

    def _ready(self):
        """The tokenizer, the id of an end, and 1 for each id that starts a word, or ends the text."""
        if self._made is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines()) if a}
            end = max(ranks.values()) + 1
            starts = np.zeros(end + 1, bool)
            starts[[r for b, r in ranks.items() if b[:1] == b" "]] = True
            starts[end] = True
            self._made = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), end, starts
        return self._made

    @property
    def end(self) -> int:
        return self._ready()[1]

    def starts(self) -> np.ndarray:
        return self._ready()[2]

    def kind(self):
        """The type that ids are kept as."""
        return np.uint16 if self.end < 1 << 16 else np.uint32

    def rest(self) -> None:
        """Give up the tokenizer until it is asked for again."""
        self._made = None

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The subword ids of all words end to end, and how many each has.  No word holds a space, so ids that start with one start a word."""
        enc, _, starts = self._ready()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = enc.encode_to_numpy(" " + b" ".join(words).decode("utf-8", "replace")).astype(np.int64)
        at = np.flatnonzero(starts[ids])
        if len(at) != len(words):  # characters that only count as white space beyond ASCII
            own = [enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
            return np.array([x for s in own for x in s], np.int64), np.array([len(s) for s in own], np.int64)
        return ids, np.diff(np.append(at, len(ids)))


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word numbers of all texts end to end, how many each text has, the words by their numbers): A-Z lower-cased, cut at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    before = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False))))
    coded = words.filter(some).dictionary_encode()
    size = np.diff(before[ends - ends[0]]).astype(np.int32)
    return coded.indices.to_numpy().astype(np.uint32), size, coded.dictionary.cast(pa.binary()).to_pylist()


BLOCK = "block long, doc_id array<long>, held array<boolean>, size array<int>, words binary, hash binary, count binary, subs binary, lens binary"


def blocks(docs: DataFrame, subwords: Subwords) -> DataFrame:
    """Texts as blocks of word numbers; each block's distinct words stand in the order of their hashes."""
    shared = docs.sparkSession.sparkContext.broadcast(subwords)

    def make(block, ids, held, texts):
        flat, size, words = numbered(texts)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        flat = place[flat]
        train = np.repeat(~held, size)
        count = np.bincount(flat[train], minlength=len(words)).astype(np.uint32)
        pieces, lens = shared.value.of([words[k] for k in order.tolist()])
        return {
            "block": [block], "doc_id": [ids], "held": [held.tolist()], "size": [size.tolist()],
            "words": [flat.astype(np.uint32).tobytes()], "hash": [hashes[order].tobytes()], "count": [count.tobytes()], "subs": [pieces.astype(shared.value.kind()).tobytes()], "lens": [lens.astype(np.uint32).tobytes()],
        }

    kinds = {"block": pa.int64(), "doc_id": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "size": pa.list_(pa.int32())}

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.small_slices(batch, BLOCK_BYTES):
                block += 1
                row = make(block, part.column(0).to_pylist(), part.column(2).to_numpy(zero_copy_only=False).astype(bool), part.column(1))
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()})
        shared.value.rest()
        common.give_back()

    held = F.coalesce(common.crc_rest(F.col("doc_id"), 10) == 0, F.lit(False)).alias("held")
    return common.stored(docs.select("doc_id", "text", held).mapInArrow(run, BLOCK), "blocks")


def _counts(table: DataFrame) -> DataFrame:
    """Training counts for each block's words: (block, bucket, counts); a row without block holds what a bucket has in all."""
    asked = table.agg(F.coalesce(F.sum(F.octet_length("hash")), F.lit(0))).first()[0] // 8
    buckets = max(16, -(-asked // BUCKET_WORDS))

    def ask(batches):
        for batch in batches:
            for block, h, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                h, c = np.frombuffer(h.as_py(), np.uint64), np.frombuffer(c.as_py(), np.uint32)
                # hashes are in order, so buckets are slices
                bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()),
                    "hash": pa.array([h[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()), "count": pa.array([c[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()),
                })

    def answer(rows: pa.Table) -> pa.Table:
        h = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("hash")]
        c = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows.column("count")])
        _, which = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(which, c).astype(np.int64)
        own = np.split(total[which], np.cumsum([len(x) for x in h])[:-1])
        n = len(own)
        return pa.table({
            "block": pa.array([*rows.column("block").to_pylist(), None], pa.int64()), "bucket": pa.array([rows.column("bucket")[0].as_py()] * (n + 1), pa.int32()),
            "counts": pa.array([*(x.tobytes() for x in own), None], pa.binary()),
            "n": pa.array([None] * n + [int(total.sum())], pa.int64()), "v": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
            "once": pa.array([None] * n + [int((total == 1).sum())], pa.int64()),
        })

    rows = table.select("block", "hash", "count").mapInArrow(ask, "bucket int, block long, hash binary, count binary")
    return common.stored(rows.groupBy("bucket").applyInArrow(answer, "block long, bucket int, counts binary, n long, v long, once long"), "counts")


def _sums(frame: DataFrame, size: int, chunk: int = 1 << 18) -> np.ndarray:
    """The sum of the arrays of `size` numbers that rows (chunk, part binary) hold in parts of `chunk`."""

    def add(rows: pa.Table) -> pa.Table:
        total = None
        for x in rows.column("part"):
            x = np.frombuffer(x.as_py(), np.float64)
            total = x.copy() if total is None else total + x
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(size)
    for k, x in frame.groupBy("chunk").applyInArrow(add, "chunk int, part binary").collect():
        x = np.frombuffer(x, np.float64)
        out[k * chunk : k * chunk + len(x)] = x
    return out


def _parts(total: np.ndarray, chunk: int = 1 << 18):
    """Rows for `_sums`."""
    for k, at in enumerate(range(0, len(total), chunk)):
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([k], pa.int32()), "part": pa.array([total[at : at + chunk].astype(np.float64).tobytes()], pa.binary())})


PARTS = "chunk int, part binary"


def _slots(before: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """The two places of pairs of subwords."""
    h = (before.astype(np.uint64) << np.uint64(32)) + after.astype(np.uint64)
    out = []
    for k, by in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
        x = h * np.uint64(by)
        out.append(((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - 18)).astype(np.int64) % SLOTS + k * SLOTS)
    return out


def _spelled(subs: np.ndarray, lens: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(subword before, subword, word) of some words, each from an `end` before it to a stop, end + 1."""
    before, after = np.full(len(subs) + len(lens), end), np.full(len(subs) + len(lens), end + 1)
    stop = np.cumsum(lens + 1) - 1
    inside = np.ones(len(after), bool)
    inside[stop] = False
    after[inside] = subs
    before[1:][inside[:-1]] = after[:-1][inside[:-1]]
    return before, after, np.repeat(np.arange(len(lens)), lens + 1)


class Spelling:
    """How new words are spelled: pairs of subwords, backed off to single ones, from counts over rare words.

    Pairs are counted at two hashed places, of which the lesser counts.
    """

    def __init__(self, counts: np.ndarray, starts: np.ndarray, back_off: float = 60.0):
        v = len(starts) + 1  # subwords, the end, and a stop
        self.back_off, self.context, self.pairs = back_off, counts[v : 2 * v], counts[2 * v :]
        once = counts[:v] + 0.05
        begins = np.append(starts, False)
        begins[v - 2], once[v - 2] = False, 0.0
        self.first, self.later = (np.where(x, once, 0.0) / max(once[x].sum(), 1e-9) for x in (begins, ~begins))

    def log10(self, subs: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Of each word's probability."""
        end = len(self.first) - 2
        before, after, word = _spelled(subs, lens, end)
        a, b = _slots(before, after)
        seen = np.minimum(np.minimum(self.pairs[a], self.pairs[b]), self.context[before])
        alone = np.where(before == end, self.first[after], self.later[after])
        # a word's first subword need not begin with a space where a text holds odd white space
        alone = np.where(alone > 0, alone, 1e-9)
        return np.bincount(word, np.log10((seen + self.back_off * alone) / (self.context[before] + self.back_off)), len(lens))


def _ids(raw: bytes, lens: np.ndarray) -> np.ndarray:
    """Subword ids of words of some lengths, kept as 16 or 32 bits."""
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * int(lens.sum()) else np.uint32)


class _Block:
    """A block's arrays as the model takes them; after its distinct words come the end and the event of a new word."""

    def __init__(self, row: dict, rows: np.ndarray):
        self.size = np.array(row["size"], np.int64)
        self.words = np.frombuffer(row["words"], np.uint32)
        self.lens = np.frombuffer(row["lens"], np.uint32).astype(np.int64)
        self.subs = _ids(row["subs"], self.lens)
        n = len(self.lens)
        self.end, self.new = n, n + 1
        self.lexicon = Lexicon(np.concatenate((rows[self.subs], rows[-1:], [1])), np.concatenate((self.lens, [1, 1])))
        self.first = np.cumsum(self.size) - self.size

    def stream(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word before, word, first, size) of some texts end to end, each with its end."""
        size = self.size[texts] + 1
        first = np.cumsum(size) - size
        target = np.full(int(size.sum()), self.end, np.int32)
        inside = np.ones(len(target), bool)
        inside[first + size - 1] = False
        own = self.size[texts]
        target[inside] = self.words[np.repeat(self.first[texts] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))]
        last = np.concatenate(([self.end], target[:-1])).astype(np.int32)
        last[first] = self.end
        return last, target, first, size


def _rows(batches, *names):
    for batch in batches:
        at = {k: batch.schema.get_field_index(k) for k in names}
        for r in range(batch.num_rows):
            yield {k: batch.column(i)[r].as_py() for k, i in at.items()}


def spelling_counts(table: DataFrame, subwords: Subwords, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each subword occurs in training texts, and the counts that `Spelling` takes."""
    v = subwords.end + 2
    size = 3 * v + 2 * SLOTS

    def run(batches):
        total = np.zeros(size)
        for row in _rows(batches, "count", "subs", "lens"):
            count, lens = np.frombuffer(row["count"], np.uint32), np.frombuffer(row["lens"], np.uint32).astype(np.int64)
            subs = _ids(row["subs"], lens).astype(np.int64)
            total[:v] += np.bincount(subs, np.repeat(count, lens), v)
            rare = (count > 0) & (count <= RARE)
            before, after, _ = _spelled(subs[np.repeat(rare, lens)], lens[rare], v - 2)
            total[v : 2 * v] += np.bincount(after, minlength=v)
            total[2 * v : 3 * v] += np.bincount(before, minlength=v)
            for x in _slots(before, after):
                total[3 * v :] += np.bincount(x, minlength=2 * SLOTS)
        yield from _parts(total)

    got = _sums(table.select("count", "subs", "lens").coalesce(tasks).mapInArrow(run, PARTS), size)
    return got[:v], got[v:]


def _flat(model: Attention) -> np.ndarray:
    return np.concatenate([getattr(model, k).ravel() for k in model.NAMES]).astype(np.float64)


def _set(model: Attention, flat: np.ndarray) -> None:
    at = 0
    for k in model.NAMES:
        old = getattr(model, k)
        setattr(model, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
        at += old.size


def shuffled(n: int, block: int, epoch: int) -> np.ndarray:
    """The windows of a block in the order of an epoch: runs of RUN that follow one another, shuffled, so that a step meets fewer different words."""
    first = np.random.default_rng([block, epoch]).permutation(-(-n // RUN)) * RUN
    order = (first[:, None] + np.arange(RUN)).ravel()
    return order[order < n]


def train(table: DataFrame, rows: np.ndarray, tasks: int, n_windows: int, least_windows: int = 80_000, batch: int = 256, most_epochs: int = 6) -> Attention:
    """A model fitted by all training windows of all blocks; rows: the row of each subword, the last one the end's.

    A table of fewer than `least_windows` windows is gone through several times, `most_epochs` at most.
    """
    spark, model = table.sparkSession, Attention(int(rows.max()) + 1)
    if not n_windows:
        return model
    epochs = min(most_epochs, max(1.0, least_windows / n_windows))
    batch = int(min(batch, max(16, epochs * n_windows / tasks // 600)))
    low = 0.0
    for k, (share, rate) in enumerate(ROUNDS):
        after = ROUNDS[k + 1][1] if k + 1 < len(ROUNDS) else 0.0
        planned = max(1.0, share * epochs * n_windows / tasks / batch)
        shared = spark.sparkContext.broadcast((model, rows))

        def run(batches, low=low, high=low + share, rate=rate, after=after, planned=planned, shared=shared):
            start, rows = shared.value
            own = Attention(len(start.spell))
            _set(own, _flat(start))
            optimiser, often, words, step = Adam(own), np.zeros(len(own.spell)), 0, 0
            for row in _rows(batches, "block", "held", "size", "words", "count", "subs", "lens"):
                texts = np.flatnonzero(~np.array(row["held"], bool))
                if not len(texts):
                    continue
                block = _Block(row, rows)
                last, target, first, size = block.stream(texts)
                # half of the words that occur once stand for new ones; words stand in the order of their hashes
                once = np.frombuffer(row["count"], np.uint32) == 1
                once[1::2] = False
                target = np.where(np.append(once, False)[target], block.new, target)
                begin, lo, hi = own.windows(first, size)
                n = len(begin)
                a, b = round(low * epochs * n), round(high * epochs * n)
                while a < b:  # each epoch in an order of its own
                    epoch = a // n
                    stop = min(b, (epoch + 1) * n)
                    order = shuffled(n, row["block"], epoch)[a - epoch * n : stop - epoch * n]
                    for at in range(0, len(order), batch):
                        pick = order[at : at + batch]
                        _, grad, used = own.gradient(block.lexicon, last, target, begin[pick], lo[pick], hi[pick])
                        step += 1
                        words += int(np.minimum(hi[pick] - begin[pick], own.step).sum())
                        often += used
                        part = min(1.0, step / planned)
                        optimiser.step(grad, (rate + (after - rate) * part) * min(1.0, step / 10) * min(1.0, 4 * len(pick) / batch))
                    a = stop
            common.give_back()
            weight = np.concatenate((np.repeat(often, own.spell.shape[1]), np.full(own.count() - own.spell.size, float(words))))
            yield from _parts(np.concatenate(((_flat(own) - _flat(start)) * weight, often, [words])))

        n = model.count()
        total = _sums(table.select("block", "held", "size", "words", "count", "subs", "lens").coalesce(tasks).mapInArrow(run, PARTS), n + len(model.spell) + 1)
        weight = np.concatenate((np.repeat(total[n:-1], model.spell.shape[1]), np.full(n - model.spell.size, total[-1])))
        _set(model, _flat(model) + total[:n] / np.maximum(weight, 1.0))
        shared.unpersist()
        low += share
    return model


def normalisers(table: DataFrame, model: Attention, rows: np.ndarray, tasks: int) -> np.ndarray:
    """For each softmax the sum of exp(tilt) over all words of training texts, without their ends."""
    shared = table.sparkSession.sparkContext.broadcast((model, rows))

    def run(batches):
        model, rows = shared.value
        total = np.zeros(model.prior.size)
        for row in _rows(batches, "count", "subs", "lens"):
            count, lens = np.frombuffer(row["count"], np.uint32), np.frombuffer(row["lens"], np.uint32)
            lexicon = Lexicon(rows[_ids(row["subs"], lens)], lens)
            on = np.flatnonzero(count)
            for at in range(0, len(on), 1 << 16):
                words, _ = lexicon.used(on[at : at + (1 << 16)])
                total += count[words] @ np.exp(model.spelled(lexicon, words)[1].astype(np.float64))
        yield from _parts(total)

    return _sums(table.select("count", "subs", "lens").coalesce(tasks).mapInArrow(run, PARTS), model.prior.size)


class Scorer:
    """A fitted model with what it knows of all training texts."""

    def __init__(self, model: Attention, rows: np.ndarray, spelling: Spelling, tokens: int, ends: int, once: int, sums: np.ndarray):
        self.model, self.rows, self.spelling = model, rows, spelling
        self.tokens, self.ends = max(1, tokens), ends
        #: Share of new words: how many of the training tokens occur once.
        self.new = min(0.5, max(1 / (self.tokens + 1), once / self.tokens)) if tokens else 0.5
        lexicon = Lexicon(np.array([rows[-1], 1]), np.array([1, 1]))
        end, new = np.exp(model.spelled(lexicon, np.array([0, 1]))[1].astype(np.float64))
        known = (sums + max(1, ends) * end) / self.tokens
        self.log_z = np.log((1 - self.new) * known + self.new * new)

    def words(self, block: _Block, count: np.ndarray):
        """For texts a to b a function that gives (word numbers, log10 probabilities) of their words and ends; count: of each distinct word, then of the end."""
        known = np.append(count, 1) > 0
        known[block.end] = True
        alone = np.zeros(len(known))
        on = np.flatnonzero(known[: block.end])
        alone[on] = np.log10((1 - self.new) * count[on] / self.tokens)
        alone[block.end] = np.log10((1 - self.new) * max(1, self.ends) / self.tokens)
        off = ~known[: block.end]
        alone[: block.end][off] = np.log10(self.new) + self.spelling.log10(block.subs[np.repeat(off, block.lens)].astype(np.int64), block.lens[off])

        def some(a: int, b: int):
            last, target, first, size = block.stream(np.arange(a, b))
            ratio = self.model.score(block.lexicon, last, np.where(known[target], target, block.new), first, size, self.log_z)
            return target, alone[target] + np.log10(np.maximum(ratio, 1e-30))

        return some


def score(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; scores are log10 probabilities.

    vocabulary: path of a public byte-pair vocabulary, which the driver reads.
    """
    with open(vocabulary, "rb") as f:
        subwords = Subwords(f.read())
    table = blocks(docs, subwords)
    tasks = max(1, -(-table.count() // TASK_BLOCKS))
    counts = _counts(table)
    n, v, once = counts.where("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "once"))).first()
    text = F.explode(F.arrays_zip("held", "size")).alias("t")
    ends, n_windows = table.select(text).where("not t.held").agg(F.count("*"), F.coalesce(F.sum(F.floor(F.col("t.size") / 32) + 1), F.lit(0))).first()
    n, v = n + ends, v + (1 if ends else 0)
    used, spelled = spelling_counts(table, subwords, tasks)
    rows = np.zeros(subwords.end + 1, np.int32)  # 0: in no training text; 1: a new word
    own = used[: subwords.end + 1] > 0
    own[subwords.end] = True
    rows[own] = np.arange(2, int(own.sum()) + 2)
    model = train(table, rows, tasks, n_windows)
    scorer = Scorer(model, rows, Spelling(spelled, subwords.starts()), n, ends, once, normalisers(table, model, rows, tasks))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        got = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist()))
        c = np.append(np.frombuffer(b"".join(got[b] for b in sorted(got)), np.int64), ends)
        row = {k: block.column(k)[0].as_py() for k in block.column_names}
        scorer = shared.value
        own = _Block(row, scorer.rows)
        base, some = np.log10((c + 0.1) / (n + 0.1 * (v + 1))), scorer.words(own, c)
        size = own.size
        out = {k: [] for k in ("n_known", "base_score", "score")}
        step, a = 24_000, 0
        ends_at = np.cumsum(size + 1)
        while a < len(size):  # some texts at a time, one at least
            b = max(a + 1, int(np.searchsorted(ends_at, (ends_at[a - 1] if a else 0) + step, side="right")))
            token, p = some(a, b)
            cuts = np.cumsum(size[a:b] + 1) - (size[a:b] + 1)
            out["n_known"] += np.add.reduceat((c > 0)[token].astype(np.int64), cuts).tolist()
            out["base_score"] += np.add.reduceat(base[token], cuts).tolist()
            out["score"] += np.add.reduceat(p, cuts).tolist()
            a = b
        common.give_back(collect=False)
        return pa.table({
            "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": size + 1, "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": np.full(len(size), n, np.int64), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
        })

    own = table.select("block", "doc_id", "held", "size", "words", "subs", "lens")
    back = counts.where("block is not null").select("block", "bucket", "counts")
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, shape)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

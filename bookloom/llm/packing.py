"""Best-fit packing of tokenised documents into fixed-length sequences by a grouping genetic algorithm.

Pieces are dealt by hash into shards of about SHARD pieces. Several islands work on each shard, each a
task of its own that evolves packings: a crossover injects whole well-filled bins of one parent into the
other, removes the bins that hold the same pieces, and best-fits the displaced ones. Between epochs each
island gets the elite of its neighbour. The best island's packing of a shard stands. A shard of a packing
that reaches the lower bound, the sum of lengths over the room, stops early.

Defined results: null and empty texts have the end id alone; only documents longer than a sequence are
cut; a text of any length is tokenised whole; repeated rows are packed each, over all shards; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialize

ROOM, END = 2048, 0
SHARD, ISLANDS, EPOCHS, POPULATION, CHILDREN = 4096, 2, 2, 4, 12
#: Words, and characters of them, that one worker remembers the ids of, in two halves: about 25 MB, and those of one chunk.
WORDS, WORD_CHARS = 100_000, 4 << 20
#: Characters of texts that are cut into words at once; longer texts are cut into such chunks at white space.
CHUNK = 1 << 19

#: Characters for which the kinds below cut and lower texts as the tokenizer does; other texts go through it whole.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
_BREAK = re.compile(r"[\t-\r ]")
#: Of a byte of lowered plain text. Bytes of one kind make a word, but a digit or a text's end is one by itself.
_SPACE, _LETTER, _SIGN, _DIGIT, _STOP = range(5)
_KINDS = np.full(256, _SIGN, np.uint8)
_KINDS[[*range(9, 14), 32]] = _SPACE
_KINDS[[*range(97, 123), *range(128, 256)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[0] = _STOP


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words of lowered plain text, one after the other, and where each begins, and the last one ends."""
    kind = _KINDS[data]
    first = np.ones(len(data), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] >= _DIGIT)
    starts = np.flatnonzero(first)
    kinds = kind[starts]
    # an apostrophe that no sign stands beside takes s, t, m, d, re, ve or ll after it
    lone = np.flatnonzero((data[starts[:-1]] == ord("'")) & (kinds[1:] == _LETTER) & (np.diff(starts) == 1))
    if len(lone):
        at = starts[lone] + 1
        one, two = data[at], data[np.minimum(at + 1, len(data) - 1)]
        pair = (two == ord("e")) & np.isin(one, list(b"rv")) | (one == ord("l")) & (two == ord("l")) & (at + 1 < len(data))
        starts[lone + 1] += np.where(pair, 2, np.isin(one, list(b"stmd")))
    sizes = np.diff(starts, append=len(data))
    return data[kind != _SPACE], np.concatenate(([0], np.cumsum(sizes[(kinds != _SPACE) & (sizes > 0)])))


class _Words:
    """Ids, as bytes, of words seen before; a chunk's distinct words are looked up once, new ones go to the model.

    Words are held in two halves: when one is full the other is forgotten but for words that are met again.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # the model knows bytes by signs of their own; the others are Latin-1's
        level = tokenizer.pre_tokenizer[1]
        signs = {c.encode().decode("latin-1"): level.pre_tokenize_str(c)[0][0] for c in "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"}
        self.signs = [(a, b) for a, b in signs.items() if a != b]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: list[str]) -> None:
        """Words that are cut and lowered already have nothing left of the tokenizer but the model."""
        text = " ".join(words).encode().decode("latin-1")
        for a, b in self.signs:
            text = text.replace(a, b)
        tokenize = self.model.tokenize
        self.known.update((w, array("I", [t.id for t in tokenize(s)]).tobytes()) for w, s in zip(words, text.split(" "), strict=True))

    def ids(self, words: list[str]) -> list[bytes]:
        """Of distinct words."""
        if 2 * len(self.known) > WORDS or 2 * self.held > WORD_CHARS:
            self.known, self.older, self.held = {}, self.known, 0
        found = list(map(self.known.get, words))
        if met := [w for w, ids in zip(words, found, strict=True) if ids is None]:
            self.held += sum(map(len, met))
            old = list(map(self.older.get, met))
            self.known.update((w, ids) for w, ids in zip(met, old, strict=True) if ids)
            if new := [w for w, ids in zip(met, old, strict=True) if not ids]:
                self.learn(new)
            found = list(map(self.known.__getitem__, words))
        return found

    def chunk(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lowered plain texts, a NUL after each being its end id, and where each text's ids end."""
        data, ends = cut(np.frombuffer(text.encode(), np.uint8))
        words = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        which, words = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        stop = words.index("\0") if "\0" in words else len(words)
        found = self.ids(words[:stop] + words[stop + 1 :])
        found.insert(stop, END.to_bytes(4, "little"))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, size = (np.cumsum(sizes) - sizes)[which], sizes[which]
        end = np.cumsum(size)
        ids = np.frombuffer(b"".join(found), "<u4")
        return ids[np.repeat(begin - end + size, size) + np.arange(size.sum())], end[which == stop]

    def each(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        ids, ends = self.chunk("\0".join([*texts, ""]))
        return np.split(ids, ends[:-1])


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    from tokenizers import Tokenizer

    return _Words(Tokenizer.from_file(path))


def _chunks(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > CHUNK and (m := _BREAK.search(text, at + CHUNK)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def text_ids(texts: Iterable[str | None], path: str) -> Iterator[np.ndarray]:
    """The tokenizer's ids of each text, made word by word where that is the same, and the end id."""
    words = _words(path)
    held: list[str | np.ndarray] = []  # a short text waits for others, a text's ids for those before it

    def flush() -> Iterator[np.ndarray]:
        parts = iter(words.each([t for t in held if isinstance(t, str)]))
        for t in held:
            yield next(parts) if isinstance(t, str) else t
        held.clear()

    size = 0
    for text in texts:
        text = text or ""
        size += len(text)
        if size > CHUNK:
            yield from flush()
            size = len(text)
        if not _PLAIN.fullmatch(text) or ("<|" in text and _SPECIAL.search(text)):
            held.append(np.array([*words.tokenizer.encode(text, add_special_tokens=False).ids, END], "<u4"))
        elif len(text) > CHUNK:
            held.append(np.concatenate([words.chunk(c)[0] for c in _chunks(f"{text.lower()}\0")]))
        else:
            held.append(text.lower())
    yield from flush()


def token_ids(text: str | None, path: str) -> np.ndarray:
    (ids,) = text_ids([text], path)
    return ids


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(documents: DataFrame, tokenizer: str | None = None, room: int = ROOM) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            who: list[int] = []
            for k, ids in enumerate(text_ids((t.as_py() for t in b.column(1)), path)):
                for p, s in enumerate(range(0, len(ids), room)):
                    part = ids[s : s + room]
                    who.append(k)
                    rows.append((p, s, len(part), zlib.crc32(part)))
            cols = zip(*rows, strict=True) if rows else ([],) * 4
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([b.column(0).take(pa.array(who, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()  # what the batch's words took

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


Packing = list[list[int]]


def best_fit(order, lengths: list[int], room: int, bins: Packing | None = None) -> Packing:
    """Each item to the fullest bin that has room for it; open bins are kept by the room they have left."""
    bins = [list(b) for b in bins or ()]
    left: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0
    for k, b in enumerate(bins):
        r = room - sum(lengths[i] for i in b)
        left[r].append(k)
        mask |= 1 << r
    for i in order:
        n = lengths[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            k = left[r].pop()
            if not left[r]:
                mask &= ~(1 << r)
            bins[k].append(i)
        else:
            r, k = room, len(bins)
            bins.append([i])
        left[r - n].append(k)
        mask |= 1 << (r - n)
    return bins


def fitness(bins: Packing, lengths: list[int]) -> tuple[int, int]:
    """Fewer bins, then fuller full bins; the least is the best."""
    return len(bins), -sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def crossover(mother: Packing, father: Packing, lengths: list[int], room: int, rng: random.Random) -> Packing:
    filled = sorted(father, key=lambda b: (-sum(lengths[i] for i in b), rng.random()))
    gift = [b for b in filled[: max(1, len(filled) // 2)] if rng.random() < 0.5] or filled[:1]
    taken = {i for b in gift for i in b}
    kept = [b for b in mother if taken.isdisjoint(b)]
    # a few of the emptiest bins go too, so that displaced items meet room to fit
    kept.sort(key=lambda b: -sum(lengths[i] for i in b))
    del kept[max(0, len(kept) - 1 - len(kept) // 50) :]
    held = taken.union(*kept)
    rest = [i for b in mother for i in b if i not in held]
    rest.sort(key=lambda i: (-lengths[i], i))
    return best_fit(rest, lengths, room, [*gift, *kept])


def evolve(lengths: list[int], room: int, seeds: list[Packing], rng: random.Random) -> Packing:
    items = [i for i, n in enumerate(lengths) if n < room]
    whole = [[i] for i, n in enumerate(lengths) if n >= room]
    bound = -(-sum(lengths[i] for i in items) // room)
    pool = [[b for b in s if lengths[b[0]] < room] for s in seeds]
    order = sorted(items, key=lambda i: (-lengths[i], i))
    while len(pool) < POPULATION:
        pool.append(best_fit(order, lengths, room))
        jitter = {i: -lengths[i] * (1 + rng.random() * 0.1) for i in items}
        order = sorted(items, key=jitter.get)
        if len(pool[-1]) <= bound:
            return [*pool[-1], *whole]
    pool.sort(key=lambda b: fitness(b, lengths))
    for _ in range(CHILDREN):
        if len(pool[0]) <= bound:
            break
        mother, father = rng.sample(pool, 2)
        pool.append(crossover(mother, father, lengths, room, rng))
        pool.sort(key=lambda b: fitness(b, lengths))
        pool.pop()
    return [*pool[0], *whole]


_COLS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def pack(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """pieces with sequence_id and offset."""
    shards = max(1, -(-pieces.count() // SHARD))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    base = f"shard int, island int, doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    # the row's place in its table spreads equal rows over shards
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard")
    # a row has its shard before it goes to the islands, so that all of them have the same pieces
    now = pieces.select(shard, *_COLS)
    now = now.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), *_COLS)
    now = now.withColumns({"of": F.lit(-1), "bin": F.lit(-1)})

    def solutions(t: pa.Table) -> tuple[pa.Table, list[Packing]]:
        """The shard's pieces in a fixed order, and the packings that came with them."""
        t = t.sort_by([(c, "ascending") for c in ["of", *_COLS, "bin"]])
        of = t.column("of").to_numpy()
        n = int((of == of[0]).sum())
        found = []
        for s in range(0, len(of), n):
            bins: dict[int, list[int]] = {}
            for i, k in enumerate(t.column("bin").slice(s, n).to_pylist()):
                bins.setdefault(k, []).append(i)
            if of[s] >= 0:
                found.append(list(bins.values()))
        return t.slice(0, n), found

    def epoch(t: pa.Table) -> pa.Table:
        own, seeds = solutions(t)
        lengths, island = own.column("length").to_pylist(), own.column("island")[0].as_py()
        rng = random.Random(f"{own.column('shard')[0].as_py()}/{island}/{len(seeds)}")
        number = np.zeros(len(lengths), np.int32)
        for k, b in enumerate(evolve(lengths, room, seeds, rng)):
            number[b] = k
        own = own.drop_columns(["of", "bin"])
        return own.append_column("of", pa.array(np.full(len(number), island, np.int32))).append_column("bin", pa.array(number))

    def final(t: pa.Table) -> pa.Table:
        own, found = solutions(t)
        lengths = own.column("length").to_pylist()
        number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(min(found, key=lambda b: fitness(b, lengths))):
            at = 0
            for i in b:
                number[i], offset[i] = k, at
                at += lengths[i]
        own = own.select(_COLS)
        return own.append_column("sequence_id", pa.array(number + (t.column("shard")[0].as_py() << 32))).append_column("offset", pa.array(offset))

    held = None
    for _ in range(EPOCHS):
        now = now.groupBy("shard", "island").applyInArrow(epoch, f"{base}, of int, bin int")
        done = materialize(now, "islands")
        discard(held)
        held = done
        # each island's elite goes on at home and next door
        now = done.withColumn("island", F.explode(F.array_distinct(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS))))))
    best = held.groupBy("shard").applyInArrow(final, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return best


def pack_documents(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(materialize(pieces(documents, tokenizer), "pieces"))

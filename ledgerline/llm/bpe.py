"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the bytes of a text cuts it: a chunk begins at a space where the hash of the WINDOW bytes before it is
divisible by CUT_EVERY. Cuts depend on what stands beside them alone, so documents that share a passage share its
chunks, and a worker encodes each chunk once. A cut could only change the ids where the tokenizer looks across it, so each
distinct join is checked: the words beside it are encoded together and apart. Where that differs, the two chunks are
made one, encoded anew, and the next join is checked, until the ids agree.

A chunk that is new is put together in the same way from its words, which it encodes once too. Joins of words inside
a chunk are checked once for each kind (two characters on both sides); a chunk with one that differs is encoded whole.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INVERSE, Bytes, byte_steps, documents, left_behind, mix, powers, table, trim

#: A chunk begins at a space if the hash of what precedes it is divisible by this.
CUT_EVERY = 128
#: Bytes under the rolling hash.
WINDOW = 16
#: Chunks, and joins of them, that a Python worker remembers, and words; beyond it the memory starts anew.
CACHE_CHUNKS, CACHE_WORDS = 40_000, 900_000


class _Tokens(dict):
    """Decoded texts of ids by their decimals, each decoded when it is met first."""

    def __init__(self, decode):
        self.decode = decode

    def __missing__(self, said: str) -> str:
        text = self[said] = self.decode([int(said)])
        return text


class ChunkEncoder:
    """Encodes texts with one tokenizer; the ids are those of encoding each whole text."""

    def __init__(self, path: str, cut_every: int = CUT_EVERY, cache_chunks: int = CACHE_CHUNKS, window: int = WINDOW):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut_every, self.cache_chunks, self.window = cut_every, cache_chunks, window
        #: what is remembered of a piece of text: its ids' decimals, joined by a space
        self.chunk: dict[str, str] = {}
        #: words with a space before them (the key is without it), and words that begin a text
        self.word: dict[str, str] = {}
        self.old_word: dict[str, str] = {}  # words of the last full memory, which come back when they are met
        self.first: dict[str, str] = {}
        #: whether the ids of two chunks side by side are those of both together, by the words beside the join
        self.agree: dict[str, bool] = {}
        #: kinds of joins inside chunks at which that is so, and those at which not
        self.sound: set[str] = set()
        self.unsound: set[str] = set()
        self.tokens = _Tokens(functools.partial(self.tokenizer.decode, skip_special_tokens=False))
        #: an added token stands between pieces that are encoded in one call: none sees its neighbours across it
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.wall, self.wall_id = next(iter(added.items()), (None, None))
        #: without a decoder, decoding puts tokens side by side, so that each can be decoded once
        self.by_token = self.tokenizer.decoder is None
        two = self.decode([0, 1])
        self.glue = two[len(self.decode([0])) : len(two) - len(self.decode([1]))]

    def chunks(self, b: Bytes) -> list[list[str]]:
        """The chunks of each text; side by side they are the text."""
        space = b.data == 32
        at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        row = np.searchsorted(b.offsets, at, side="right") - 1
        at = at[at - self.window >= b.offsets[row]]
        h, inverse = b.prefix_hash(), powers(len(b.data) + 1, _INVERSE)
        rolled = mix((h[at] - h[at - self.window]) * inverse[at - self.window])
        at = at[rolled % np.uint64(self.cut_every) == 0]
        data, out = b.data.tobytes(), []
        for start, end in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True):
            edges = [start, *at[np.searchsorted(at, start, side="right") : np.searchsorted(at, end)].tolist(), end]
            out.append([data[i:j].decode() for i, j in zip(edges, edges[1:], strict=False)])
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text on its own, many texts a call."""
        whole = lambda part: [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        if self.wall is None:
            return whole(texts)
        out: list[list[int]] = []
        for at in range(0, len(texts), 500):
            part = texts[at : at + 500]
            ids = whole([self.wall.join(part)])[0]
            walls = np.flatnonzero(np.array(ids) == self.wall_id).tolist()
            if len(walls) != len(part) - 1:  # a text holds the added token itself
                out += whole(part)
            else:
                out += [ids[i:j] for i, j in zip([0, *(w + 1 for w in walls)], [*walls, len(ids)], strict=True)]
        return out

    def _known(self, texts: list[str]) -> list[str]:
        return [" ".join(map(str, ids)) for ids in self._encode(texts)]

    def _agree(self, pairs: list[tuple[str, str]]) -> list[bool]:
        """For each two known pieces: whether their ids side by side are those of both together."""
        of = lambda piece: self.word[piece[1:]] if piece[:1] == " " else self.first[piece]
        both = self._encode([a + b for a, b in pairs])
        return [" ".join(filter(None, (of(a), of(b)))) == " ".join(map(str, x)) for (a, b), x in zip(pairs, both, strict=True)]

    @staticmethod
    def beside(a: str, b: str) -> str:
        """The last word before a join and the first after it, with the spaces before them."""
        end = b.find(" ", 1)
        return a[max(0, a.rfind(" ")) :] + (b if end < 0 else b[:end])

    def learn(self, texts: list[list[str]]) -> None:
        """Encode, once, the chunks that aren't known yet, and check the joins that aren't."""
        for cache, most in ((self.chunk, self.cache_chunks), (self.agree, self.cache_chunks), (self.first, CACHE_WORDS), (self.sound, CACHE_WORDS), (self.unsound, CACHE_WORDS)):
            if len(cache) > most:
                cache.clear()
        if len(self.word) > CACHE_WORDS // 2:
            self.word, self.old_word = {}, self.word
        new = {c: c.split(" ") for c in set().union(*texts) - self.chunk.keys()}
        joins = {self.beside(a, b) for chunks in texts for a, b in zip(chunks, chunks[1:], strict=False)}
        parted = {j: (j[: j.rfind(" ")], j[j.rfind(" ") :]) for j in joins if j not in self.agree}
        beside = [w for pair in parted.values() for w in pair]
        words = [w for w in set().union(*(p[1:] for p in new.values()), (w[1:] for w in beside if w[0] == " ")) if w not in self.word]
        self.word.update((w, self.old_word[w]) for w in words if w in self.old_word)
        words = [w for w in words if w not in self.old_word]
        self.word.update(zip(words, self._known([" " + w for w in words]), strict=True))
        first = [w for w in {*(p[0] for p in new.values() if p[0]), *(w for w in beside if w[0] != " ")} if w not in self.first]
        self.first.update(zip(first, self._known(first), strict=True))
        self.agree.update(zip(parted, self._agree(list(parted.values())), strict=True))

        kinds = {c: {a[-2:] + " " + b[:2] for a, b in zip(p, p[1:], strict=False)} if p[0] else {a[-2:] + " " + b[:2] for a, b in zip(p[1:], p[2:], strict=False)} for c, p in new.items()}
        open_ = {k for k in set().union(*kinds.values()) if k not in self.sound and k not in self.unsound}
        asked: dict[str, tuple[str, str]] = {}  # kinds that stand for the first time, with the words where they do
        for c, p in new.items():
            if here := kinds[c] & open_:
                open_ -= here
                for i in range(0 if p[0] else 1, len(p) - 1):
                    if (k := p[i][-2:] + " " + p[i + 1][:2]) in here:
                        asked[k] = ((" " if i else "") + p[i], " " + p[i + 1])
        for k, fits in zip(asked, self._agree(list(asked.values())), strict=True):
            (self.sound if fits else self.unsound).add(k)
        whole = [c for c in new if not kinds[c] <= self.sound]
        self.chunk.update(zip(whole, self._known(whole), strict=True))
        word = self.word
        for c, p in new.items():
            if c not in self.chunk:
                parts = [word[w] for w in p[1:]]
                self.chunk[c] = " ".join(filter(None, [self.first[p[0]], *parts] if p[0] else parts))

    def join(self, chunks: list[str]) -> str:
        """The decimals of a text's ids from its chunks, all of them learned."""
        done: list[str] = []
        last = ""
        for chunk in chunks:
            if done and not self.agree[self.beside(last, chunk)]:
                last += chunk
                done[-1] = self._known([last])[0]
            else:
                last = chunk
                done.append(self.chunk[chunk])
        return " ".join(filter(None, done))

    def encode_all(self, b: Bytes) -> list[tuple[int, str, str]]:
        """Of each text: the number of its ids, their decimals and their decoded text."""
        texts = self.chunks(b)
        self.learn(texts)
        return [(said.count(" ") + bool(said), said, self.decode_said(said)) for said in map(self.join, texts)]

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        data = np.frombuffer(text.encode(), np.uint8)
        return [int(i) for i in self.encode_all(Bytes(pa.array([0]), data, np.array([0, len(data)])))[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def decode_said(self, said: str) -> str:
        """decode() of decimals, with each token decoded once where this tokenizer decodes token by token."""
        ids = said.split()
        return self.glue.join(map(self.tokens.__getitem__, ids)) if self.by_token else self.decode([int(i) for i in ids])


@functools.cache
def worker_encoder(path: str) -> ChunkEncoder:
    """One encoder for the tasks that a worker runs one after the other: what it remembers changes no result."""
    return ChunkEncoder(path)


def _forget() -> None:
    """Drop the encoder of this worker."""
    if worker_encoder.cache_info().currsize:
        worker_encoder.cache_clear()
        gc.unfreeze()
        gc.collect()


left_behind.append(_forget)


def encode_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if kept, ids (array<int>) and decoded (string).

    Null texts count as empty; an empty text has no tokens and decodes to an empty text. Equal texts get equal ids.
    Rows are kept one for one, repeated and null doc_ids too. No shuffle: each worker encodes the distinct chunks it meets.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.list_(pa.int32()))] * keep_ids + [("decoded", pa.string())] * keep_text
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        coder = worker_encoder(tokenizer_path)
        gc.freeze()  # what is remembered holds no cycles
        for batch in batches:
            for b in byte_steps([batch]):
                n, said, decoded = zip(*coder.encode_all(b), strict=True)
                ids = [[int(i) for i in x.split()] for x in said] if keep_ids else []
                sha = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts])
                out = [b.ids, pa.array(n, pa.int64()), sha(said), sha(decoded)]
                out += [pa.array(ids, pa.list_(pa.int32()))] * keep_ids + [pa.array(decoded)] * keep_text
                yield pa.RecordBatch.from_arrays(out, schema=schema)
            batch = b = None  # the next task of this worker begins without them
            trim()

    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    return documents(docs).mapInArrow(run, sql)


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_path(), keep_ids=False, keep_text=False)

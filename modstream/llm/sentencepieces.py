"""SentencePiece encoding and decoding with the tokenizers library, rebuilt from the model's protobuf."""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modstream.llm.arrays import give_back, pieces
from modstream.llm.common import small_batches

MARK = "▁"
#: Where the query finds a model; a parameter everywhere else.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Threads with which a task encodes a batch.
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def parse_model(data: bytes):
    """The model's protobuf message."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(data)
    return proto


def _merges(proto) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, best score first; of one piece in the order of its parts' ids."""
    ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, i in ids.items():
        score = proto.pieces[i].score
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in ids and right in ids:
                found.append((-score, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuilt(data: bytes):
    """A tokenizer of the tokenizers library that does what the SentencePiece model ``data`` does.

    Normaliser (character map, extra blanks, the blank in front), the mark for blanks, unigram scores or merges in order of score,
    and bytes for unknown characters come from the protobuf. Control pieces are never produced from text.
    """
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    proto = parse_model(data)
    trainer, norm = proto.trainer_spec, proto.normalizer_spec
    if trainer.treat_whitespace_as_suffix:
        raise ValueError("marks after words aren't supported")
    unk = proto.pieces[trainer.unk_id].piece
    if trainer.model_type == UNIGRAM:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], trainer.unk_id, trainer.byte_fallback)
    elif trainer.model_type == BPE:
        vocabulary = {p.piece: i for i, p in enumerate(proto.pieces)}
        model = models.BPE(vocabulary, _merges(proto), unk_token=unk, fuse_unk=True, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} isn't supported")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if norm.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    # No piece has a mark after another character: then texts may be cut before marks, and words are looked up in a cache.
    if not any(a != MARK and b == MARK for p in proto.pieces if p.type == NORMAL for a, b in itertools.pairwise(p.piece)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tokenizer.decoder = _decoder(norm.add_dummy_prefix)
    return tokenizer


def _decoder(prefix: bool):
    from tokenizers import decoders

    steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    return decoders.Sequence([*steps, decoders.Strip(" ", 1, 0)] if prefix else steps)


def _threads(n: int) -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    os.environ.setdefault("RAYON_NUM_THREADS", str(n))


class Encoder:
    """Encodes batches of texts with ``rebuilt``, and compares with the sentencepiece library.

    If the model lets texts be cut before marks, both libraries work word by word: a batch's new words are encoded as lists of PART
    words, decoded, and encoded by the other library too; the outcome is remembered, by words without the mark that each has in front. Words met since CACHE bytes of words
    were last full are ``known``; those of the time before are ``old`` and become known when they are met again, so frequent words stay.
    A text's ids are those of its words. Otherwise whole texts are encoded.
    """

    #: About the bytes of the known words and their ids, with OVERHEAD for each, and as many old ones; words of more than LONG characters aren't kept.
    CACHE, OVERHEAD, LONG = 32 << 20, 200, 1_000
    PART = 2_000

    def __init__(self, data: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = rebuilt(data)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.by_word = self.tokenizer.pre_tokenizer is not None
        self.words = Tokenizer(self.tokenizer.model)
        self.words.decoder = _decoder(False)
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        proto = parse_model(data)
        self.alone = [self.other.piece_to_id(MARK)]
        self.spelled = [p.piece if p.type in (NORMAL, USER_DEFINED) else "" for p in proto.pieces]
        self.odd = np.array([not x for x in self.spelled])
        #: Bytes of text that a piece stands for; 0 if that isn't known.
        self.bytes = np.array([1 if p.type == BYTE else len(p.piece.encode()) * (p.type in (NORMAL, USER_DEFINED, UNUSED)) for p in proto.pieces])
        norm = proto.normalizer_spec
        self.plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        self.by_word = self.by_word and self.plain
        self.known: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.lossy: set[str] = set()
        self._forget()

    def _forget(self) -> None:
        """Known words become old ones; what was old is gone."""
        self.old, self.known, self.size = self.known, {}, 0
        self.unlike = {w for w in self.unlike if w in self.old}
        self.lossy = {w for w in self.lossy if w in self.old}

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's end."""
        parts = [words[k : k + self.PART] for k in range(0, len(words), self.PART)]
        found = self.words.encode_batch_fast(parts, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in found])
        # A list's ids come without their words: these end where the pieces' bytes do.
        sizes, ends = self.bytes[ids], np.cumsum([len(w.encode()) for w in words])
        places = np.cumsum(sizes)
        at = np.searchsorted(places, ends)
        if len(ids) and sizes.all() and places[-1] == ends[-1] and (places[at] == ends).all():
            return ids, at + 1
        alone = [e.ids for e in self.words.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([*itertools.chain.from_iterable(alone)], dtype=np.int32), np.cumsum([len(i) for i in alone])

    def _learn(self, new: list[str]) -> None:
        marked = [MARK + w for w in new]
        ids, ends = self._encoded(marked)
        starts = np.concatenate([[0], ends[:-1]])
        data, cuts = ids.tobytes(), zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)
        self.known.update(zip(new, [data[a:b] for a, b in cuts], strict=True))
        # The other library puts the mark in front itself; a mark alone it can't be asked for.
        theirs = [i if w else self.alone for w, i in zip(new, self.other.encode([w.replace(MARK, " ") for w in new], num_threads=1), strict=True)]
        flat = np.fromiter(itertools.chain.from_iterable(theirs), dtype=np.int32)
        if not (np.array_equal(flat, ids) and np.array_equal(np.cumsum([len(i) for i in theirs]), ends)):
            self.unlike.update(w for w, i in zip(new, theirs, strict=True) if self.known[w] != array("i", i).tobytes())
        # Pieces that spell the word decode to it; bytes and unknown pieces are decoded.
        odd = np.concatenate([[0], np.cumsum(self.odd[ids])])
        doubtful = odd[ends] > odd[starts]
        plain = ids[~np.repeat(doubtful, ends - starts)].tolist()
        if "".join(map(self.spelled.__getitem__, plain)) != "".join(itertools.compress(marked, ~doubtful)):
            doubtful[:] = True
        at = np.flatnonzero(doubtful).tolist()
        backs = self.words.decode_batch([ids[starts[k] : ends[k]].tolist() for k in at], skip_special_tokens=False) if at else []
        self.lossy.update(new[k] for k, back in zip(at, backs, strict=True) if back != marked[k].replace(MARK, " "))

    def _cut(self, text: str) -> list[str]:
        """The words of a text, without the mark in front of each."""
        if text and (text[0] == " " or text[-1] == " " or "  " in text or MARK in text):
            return [w[1:] for w in self.cut(MARK + text.replace(" ", MARK))]
        return text.split(" ") if text else []

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Of each text the ids (as 32-bit numbers), whether they decode to the text, and whether the other library agrees."""
        if not self.by_word:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            backs = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            theirs = self.other.encode(texts, num_threads=1)
            same = lambda a, b: [x == y for x, y in zip(a, b, strict=True)]
            return [np.array(i, dtype=np.int32).tobytes() for i in ids], same(backs, texts), same(ids, theirs)
        cut = [self._cut(t) for t in texts]
        new = set().union(*cut) - self.known.keys()
        again = new & self.old.keys()
        self.known.update((w, self.old[w]) for w in again)
        self.size += 5 * sum(map(len, new)) + self.OVERHEAD * len(new)
        if new := list(new - again):
            self._learn(new)
        ids = [b"".join(map(self.known.__getitem__, words)) for words in cut]
        trips = [MARK not in t and self.lossy.isdisjoint(words) for t, words in zip(texts, cut, strict=True)]
        agree = [not self.unlike or self.unlike.isdisjoint(words) for words in cut]
        for word in [w for w in new if len(w) > self.LONG]:
            del self.known[word]
            self.size -= 5 * len(word) + self.OVERHEAD
            self.unlike.discard(word)
            self.lossy.discard(word)
        if self.size > self.CACHE:
            self._forget()
        return ids, trips, agree


def encode(docs: DataFrame, model: str = MODEL, threads: int = THREADS, batch_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip and parity of every row of ``docs`` (doc_id, text).

    ``model`` is a path on the driver; the model is broadcast (some hundred KB to a few MB) and rebuilt once in each Python worker.
    Batches are encoded with ``threads`` threads, and everything is also encoded by the sentencepiece library: parity says that
    both give the same ids. round_trip says that the decoded ids are the text. Neither is a filter. A null text counts as empty and
    has no tokens; repeated rows and null ids are encoded each; no rows give no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    with open(model, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        encoder = Encoder(sent.value)
        for batch in pieces(batches, size=batch_bytes):
            ids, trips, same = encoder([t or "" for t in batch.column(1).to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(ends).astype(np.int64)), lists, pa.array(trips, pa.bool_()), pa.array(same, pa.bool_())],
                ["doc_id", "n_tokens", "ids", "round_trip", "parity"],
            )
        del encoder
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """(doc_id, text) of ``encoded`` (doc_id, ids); null ids give a null text."""
    with open(model, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _threads(threads)
        tokenizer = rebuilt(sent.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                ids = part.column(1).to_pylist()
                texts = tokenizer.decode_batch([i or [] for i in ids], skip_special_tokens=False)
                texts = [None if i is None else t for i, t in zip(ids, texts, strict=True)]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")

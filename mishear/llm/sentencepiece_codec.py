"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

Text becomes marked words: white space turns into the mark, and a word begins
at each run of marks and around each character that no longer piece holds, as
no piece crosses such a place. The distinct words of a slice are sorted, which
lays them out as the depth-first order of a trie: each word keeps the forward
states of the prefix that it shares with the word before, and only the rest is
searched.

Two kinds of model are searched alike; they differ in what a step may do:

* unigram: the best sum of scores over all segmentations;
* BPE: merging by rank gives each prefix one last piece, the only piece q whose
  predecessor p, the last piece of the prefix before q, satisfies
  merge(p + q) = (p, q). Piece pairs are tested once and remembered. So the
  search finds what merging finds, with prefixes shared.

A character in no piece becomes its bytes' pieces, if the model has them, else
the unknown piece. Decoding joins pieces, bytes and all, and drops the leading
mark.

Defined cases: a null text is an empty one (no ids); null ids of pieces, and
those that the model has not, decode as the unknown piece; a very long text is
one task's work, and so is a very long word, which takes some 25 bytes of memory
a character; repeated rows are encoded each; an empty table gives no rows; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishear.llm._arrow import gather, list_array, remembered, slices, tidy

MARK = "▁"
#: Words that a worker remembers between slices, text that is encoded at once (the more, the more prefixes are
#: shared) and ids that are decoded at once.
CACHE_WORDS, SLICE_BYTES, DECODED_IDS = 300_000, 24 << 20, 1 << 20
#: Pairs of pieces that a worker remembers between words.
CACHE_PAIRS = 1_000_000
#: Kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Characters that may stand between words: the first that neither a text nor a piece has.
SEPARATORS = "\x00\x01\x02\x03\x04\x05\ue000\uf8ff\U000f0000\U0010fffd"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            n = varint() if n is None else n
            yield key >> 3, data[at : at + n]
            at += n


class Codec:
    """A model file's pieces, and the searches over them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.kind, self.prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(fields(value))
                charsmap, self.prefix, self.squeeze = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        if charsmap or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with identity normalization are read")
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(self.pieces[i][3:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.unknown_score = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        self._automaton()
        self.valid: dict[int, bool] = {}
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.words_split = not crossing
        self.separators = [c for c in SEPARATORS if not any(c in p for p in self.ids)]
        self.breaks = [c for c in "\n\r\t" if not any(c in p for p in self.ids)]
        out = [b" ".join(p.encode().split(MARK.encode())) for p in self.pieces]
        for i, k in enumerate(kinds):
            if k == BYTE:
                out[i] = bytes([int(self.pieces[i][3:-1], 16)])
            elif k == UNKNOWN:
                out[i] = " ⁇ ".encode()
            elif k not in (NORMAL, 4):
                out[i] = b""
        self.flat = np.frombuffer(b"".join(out), np.uint8)
        self.decoded_sizes = np.fromiter(map(len, out), np.int64, len(out))
        self.cache: dict[str, bytes] = {}

    # words

    def merged(self, text: str) -> list[str]:
        """The pieces that merging by rank leaves."""
        parts = list(text)
        while len(parts) > 1:
            pairs = [self.ids.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((i for i in pairs if i is not None), key=lambda i: self.scores[i], default=None)
            if best is None:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair_valid(self, before: int, piece: int) -> bool:
        """Whether merging leaves these two pieces as they are; before: -1 for none."""
        key = before * 2**32 + piece
        ok = self.valid.get(key)
        if ok is None:
            own = [self.pieces[i] for i in (before, piece) if i >= 0]
            ok = self.valid[key] = self.merged("".join(own)) == own
        return ok

    def _finish(self, last: array, since: array, word: str) -> bytes:
        """Ids along the way back from the end of ``word``."""
        out: list[int] = []
        at = len(word)
        while at:
            piece, start = last[at], since[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(word[start:at].encode())]
            else:
                while start and last[start] < 0:  # a run of unknown characters is one piece
                    start = since[start]
                out.append(self.unknown)
            at = start
        out.reverse()
        return array("I", out).tobytes()

    def _automaton(self) -> None:
        """States are prefixes of pieces: the steps from each, and all pieces that end there, longest first."""
        self.steps: list[dict[str, int]] = [{}]
        own: list[tuple[tuple[int, int], ...]] = [()]
        for piece, i in self.ids.items():
            at = 0
            for c in piece:
                to = self.steps[at].get(c)
                if to is None:
                    to = self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    own.append(())
                at = to
            own[at] = ((i, len(piece)),)
        self.fallback = [0] * len(own)
        self.ending = own
        level = list(self.steps[0].values())
        while level:
            for at in level:
                for c, to in self.steps[at].items():
                    back = self.fallback[at]
                    while back and c not in self.steps[back]:
                        back = self.fallback[back]
                    self.fallback[to] = self.steps[back].get(c, 0)
                own[at] += own[self.fallback[at]]
            level = [to for at in level for to in self.steps[at].values()]

    def _step(self, at: int, c: str) -> int:
        while at and c not in self.steps[at]:
            at = self.fallback[at]
        return self.steps[at].get(c, 0)

    def search(self, words: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each word, for words in sorted order."""
        steps, ending, scores, known = self.steps, self.ending, self.scores, self.valid
        bpe, unknown_score = self.kind == BPE, self.unknown_score
        # by depth: state, last piece (-1: none or an unknown character), its start, best score
        state, last, since, best = array("i", [0]), array("i", [-1]), array("i", [0]), array("d", [0.0])
        before = ""
        for word in words:
            if len(known) > CACHE_PAIRS:
                known.clear()
            keep = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                keep += 1
            del state[keep + 1 :], last[keep + 1 :], since[keep + 1 :], best[keep + 1 :]
            at = state[keep]
            for end in range(keep + 1, len(word) + 1):
                c = word[end - 1]
                to = steps[at].get(c)
                at = self._step(at, c) if to is None else to
                found, start, top = -1, end - 1, 0.0
                for piece, length in ending[at]:
                    if bpe:
                        left = last[end - length]
                        ok = known.get(left * 4294967296 + piece)
                        if self.pair_valid(left, piece) if ok is None else ok:
                            found, start = piece, end - length
                            break
                    else:
                        score = best[end - length] + scores[piece]
                        if found < 0 or score > top:
                            found, start, top = piece, end - length, score
                if found < 0:
                    top = best[end - 1] + unknown_score
                state.append(at)
                last.append(found)
                since.append(start)
                best.append(top)
            before = word
            yield self._finish(last, since, word)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words; those not remembered are sorted and searched."""
        cache = self.cache
        out = list(map(cache.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        missing.sort(key=words.__getitem__)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        room = CACHE_WORDS - len(cache)
        for n, (i, ids) in enumerate(zip(missing, self.search([words[i] for i in missing]))):
            out[i] = ids
            if n < room:
                cache[words[i]] = ids
        return out

    # texts

    def _marked(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Words of all texts, and where those of each text begin."""
        texts = texts.cast(pa.large_string())
        if self.squeeze:
            texts = pc.replace_substring_regex(pc.utf8_trim(texts, " "), " +", " ")
        if self.prefix:
            lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
            texts = pc.binary_join_element_wise(lead.cast(pa.large_string()), texts, pa.scalar("", pa.large_string()))
        mark = next((c for c in self.separators if not pc.any(pc.match_substring(texts, c)).as_py()), None)
        if not self.words_split or mark is None:
            out = [[t.replace(" ", MARK)] if t else [] for t in texts.to_pylist()]
            return np.append(0, np.cumsum([len(x) for x in out])), pa.array([w for x in out for w in x], pa.large_string())
        # a separator before each run of marks and around characters that no longer piece holds
        texts = pc.replace_substring(texts, " ", MARK)
        texts = pc.replace_substring(texts, MARK, mark + MARK)
        texts = pc.replace_substring(texts, MARK + mark, MARK)
        for c in self.breaks:
            texts = pc.replace_substring(texts, c, mark + c + mark)
        parts = pc.split_pattern(texts, mark)
        words, offsets = parts.flatten(), parts.offsets.to_numpy()
        some = pc.greater(pc.binary_length(words), 0)
        kept = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
        return kept[offsets - offsets[0]], words.filter(some)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (and the last's end)."""
        offsets, words = self._marked(texts)
        coded = words.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        own = self.encode_words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), np.int32, len(own)) // 4
        ids = gather(np.frombuffer(b"".join(own), "<u4"), sizes, index)
        return ids, np.append(0, np.cumsum(sizes[index], dtype=np.int64))[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids; those that the model has not are unknown."""
        ids = np.where((ids >= 0) & (ids < len(self.pieces)), ids, self.unknown)
        out: list[bytes] = []
        cut = 1 if self.prefix else 0
        first = 0
        while first + 1 < len(offsets):
            stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + DECODED_IDS, side="right")) - 1)
            own = ids[offsets[first] : offsets[stop]]
            joined = gather(self.flat, self.decoded_sizes, own).tobytes()
            ends = np.append(0, np.cumsum(self.decoded_sizes[own]))[offsets[first : stop + 1] - offsets[first]].tolist()
            out += [joined[a + cut if joined[a : a + 1] == b" " and a < b else a : b] for a, b in zip(ends, ends[1:])]
            first = stop
        return out


@remembered(2)
def codec_of(path: str) -> Codec:
    """One for each worker, so that it remembers words from task to task."""
    return Codec(path)


def _rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of each row."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, offsets = codec.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), list_array(ids.astype(np.int32), offsets, pa.int32())], names=["doc_id", "ids"])

    return _rows(docs, id_column, text).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with ids; bytes that are no UTF-8 become U+FFFD."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            own = pc.fill_null(batch.column("ids"), [])
            offsets = own.offsets.to_numpy()
            texts = codec.decode(pc.fill_null(own.flatten(), codec.unknown).to_numpy(zero_copy_only=False), offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    own = rows.select(F.col(id_column).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return own.mapInArrow(run, "doc_id long, text string")


def digests(model: str) -> Callable:
    """Encodes, decodes and digests in one pass: ids are several times as large as their digests."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, offsets = codec.encode(part.column("text"))
                data = memoryview(np.ascontiguousarray(ids)).cast("B")
                texts = codec.decode(ids, offsets)
                at = (4 * offsets).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                        pc.equal(pa.array(texts, pa.large_binary()), part.column("text").cast(pa.large_binary())),
                    ],
                    names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"],
                )

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return docs.mapInArrow(
        digests(public_tokenizers.path("piece_bpe_32k.model")),
        "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean",
    )

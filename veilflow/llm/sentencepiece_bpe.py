"""SentencePiece BPE encoding and decoding without the library's merge loop.

A sequence of pieces is the encoding of a text if, and only if, each two neighbours, joined and merged again from characters, come
apart as the same two pieces: no merge that the whole text would have made can then cross a border.  The encoder walks a text once,
takes the longest piece that Aho-Corasick reports at each position, checks it against the piece before it by re-merging that pair
(memorised), and steps back where nothing fits.  The encoding of a prefix is unique, so a position that failed once has failed for
good; a bitfield remembers it and keeps the walk linear.

No piece has a space mark after another character, none holds a line feed, and none mixes letters with other characters, so texts
fall apart into runs of letters or of others, each with the space marks before it, and single line feeds; runs that repeat are encoded
once per worker or task, as long as they are remembered.  These facts are checked when a model is loaded; a text is split less, or not at all, where they don't hold.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilflow.llm.scratch import small_batches, tidied

MARK = "▁"
#: Runs of a generation that a worker remembers: for one task, or over tasks.
_TASK_CACHE, _KEPT_CACHE = 50_000, 250_000
_LONGEST_CACHED = 64


class _Known(dict):
    """What is known of short runs, in two generations: one that is full becomes the old one, from which runs that come again are taken over."""

    def __init__(self, owner: "PieceCodec"):
        super().__init__()
        self.owner, self.most, self.old = owner, _TASK_CACHE, {}

    def work_out(self, text: str):
        raise NotImplementedError

    def __missing__(self, text: str):
        value = self.old.get(text)
        if value is None:
            value = self.work_out(text)
        if len(text) <= _LONGEST_CACHED:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[text] = value
        return value

    def forget(self) -> None:
        self.old = {}
        self.clear()


class _Runs(_Known):
    """Encodings of runs: (ids as little-endian 32-bit integers, what they decode to)."""

    def work_out(self, text: str) -> tuple[bytes, str]:
        ids = self.owner.ids_of_run(text)
        return array("I", ids).tobytes(), self.owner._plain(ids)


class _Counts(_Known):
    """Numbers of ids of runs."""

    def work_out(self, text: str) -> int:
        return len(self.owner.ids_of_run(text))


class PieceCodec:
    """Encodes and decodes as the sentencepiece library does with the same BPE model (identity normalisation, byte fallback)."""

    def __init__(self, model_file: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.bos, self.eos, self.unk = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.byte_of = {i: int(self.pieces[i][3:-1], 16) for i in range(n) if lib.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte_of.items()}
        self.silent = {i for i in range(n) if lib.is_control(i)}
        self.last_special = max(*self.byte_of, *self.silent, self.unk, -1)
        if len(self.byte_id) != 256:
            raise NotImplementedError("the model has no byte fallback")
        if lib.encode("ﬁ  a ", out_type=str)[-3:] != [MARK * 2, "a", MARK] and lib.decode(lib.encode(" ﬁ  a ")) != " ﬁ  a ":
            raise NotImplementedError("the model normalises its input")
        self.id_of = {p: i for i, p in enumerate(self.pieces) if not (i in self.byte_of or i in self.silent or i == self.unk)}
        if any(lib.is_unused(i) for i in self.id_of.values()):
            raise NotImplementedError("the model has unused pieces")
        self.inside = {c for p in self.id_of for c in p}
        self.score = {p: lib.get_score(i) for p, i in self.id_of.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.split = re.compile(self._borders()).findall
        self.fits: dict[int, bool] = {}
        self.runs = _Runs(self)
        self.counts = _Counts(self)

    def _borders(self) -> str:
        """A pattern for runs between which no piece reaches, as far as the vocabulary shows."""
        bare = [p.lstrip(MARK) for p in self.id_of]
        if any(MARK in p or "\n" in p for p in bare):
            return r"(?s).+"
        digits = "".join(sorted(c for c in self.inside if c.isalnum() and not c.isalpha() and not c.isdecimal()))
        letter, other = rf"[^\W\d_{digits}]", rf"(?![{MARK}\n])[\W\d_{digits}]"
        letters, some = re.compile(f"{letter}+"), re.compile(letter)
        if all(letters.fullmatch(p) or not some.search(p) for p in bare if p):
            return rf"{MARK}*{letter}+|{MARK}*(?:{other})+|{MARK}+|\n"
        return f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"

    def remerge(self, text: str) -> list[str]:
        """The merge loop itself, for one piece or two: the best-scored neighbours join first, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether both pieces survive side by side; left -1 asks whether the right one survives alone."""
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 250_000:
                self.fits.clear()
            a, b = self.pieces[left] if left >= 0 else "", self.pieces[right]
            known = self.fits[key] = self.remerge(a + b) == ([a, b] if a else [b])
        return known

    def ids_of_run(self, text: str) -> list[int]:
        """The ids of one run, by backtracking over Aho-Corasick matches.

        The walk that never steps back is tried first, over leftmost-longest matches alone; most runs need no more.
        """
        get, compatible = self.fits.get, self.compatible
        last, out, end = -1, [], -1
        for at, (length, i) in self.automaton.iter_long(text):
            fit = get(last << 32 | i)
            if at - length != end or not (compatible(last, i) if fit is None else fit):
                break
            out.append(i)
            last, end = i, at
        else:
            if end == len(text) - 1:
                return out
        n = len(text)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for at, match in self.automaton.iter(text):
            found[at - match[0] + 1].append(match)
        for matches in found:
            if not matches or matches[0][0] != 1:
                return self._ids_with_strangers(text)
        failed = 0  # bit p: no encoding goes through position p
        path: list[tuple[int, int, int]] = []
        pos, last, choice = 0, -1, len(found[0]) - 1
        while pos < n:
            matches = found[pos]
            while choice >= 0:
                length, i = matches[choice]
                fit = get(last << 32 | i)
                if (compatible(last, i) if fit is None else fit) and not failed >> (pos + length) & 1:
                    path.append((pos, choice, i))
                    pos += length
                    last = i
                    choice = len(found[pos]) - 1 if pos < n else 0
                    break
                choice -= 1
            else:
                failed |= 1 << pos
                pos, choice, _ = path.pop()
                last = path[-1][2] if path else -1
                choice -= 1
        return [x[2] for x in path]

    def _ids_with_strangers(self, text: str) -> list[int]:
        """A run with characters that are no pieces: they become bytes, and no merge reaches across them unless a piece holds one."""
        out: list[int] = []
        known = [c in self.id_of for c in text]
        if any(not k and c in self.inside for c, k in zip(text, known, strict=True)):
            parts = self.remerge(text)
        else:
            parts, i = [], 0
            while i < len(text):
                j = i + 1
                while known[i] and j < len(text) and known[j]:
                    j += 1
                if known[i]:
                    out.extend(self.ids_of_run(text[i:j]))
                else:
                    out.extend(self.byte_id[b] for b in text[i].encode())
                i = j
        for p in parts:
            out.extend([self.id_of[p]] if p in self.id_of else [self.byte_id[b] for b in p.encode()])
        return out

    def run(self, text: str) -> tuple[bytes, str]:
        """Ids of a run as little-endian 32-bit integers, and what these ids decode to inside a text."""
        return self.runs[text]

    def marked(self, text: str) -> list[str]:
        return self.split(MARK + text.replace(" ", MARK)) if text else []

    def count(self, text: str) -> int:
        """Number of ids without begin and end."""
        return sum(map(self.counts.__getitem__, self.marked(text)))

    def encode(self, text: str, bos: bool = False, eos: bool = False) -> list[int]:
        raw = b"".join(self.run(r)[0] for r in self.marked(text))
        ids = list(memoryview(raw).cast("I")) if raw else []
        return [self.bos] * bos + ids + [self.eos] * eos

    def _plain(self, ids: Iterable[int]) -> str:
        """Pieces joined, space marks as spaces, runs of bytes as UTF-8; control ids are silent."""
        if min(ids, default=0) > self.last_special:
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if i in self.silent:
                continue
            if raw:
                out.append(_utf8(raw))
                raw = bytearray()
            out.append(" ⁇ " if i == self.unk else self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(_utf8(raw))
        return "".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids; the space that encoding puts in front is taken off again."""
        ids = [i for i in ids if i not in self.silent]
        text = self._plain(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(MARK) else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids with begin and end, SHA-256 of the ids, SHA-256 of the decoded text."""
        runs = list(map(self.runs.__getitem__, self.marked(text or "")))
        raw = self.bos.to_bytes(4, "little") + b"".join([r[0] for r in runs]) + self.eos.to_bytes(4, "little")
        # A run decodes by itself: it ends at a whole character, so bytes of one character never meet across a border.
        plain = "".join([r[1] for r in runs])
        return len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(plain[1:].encode()).hexdigest()


def _utf8(raw: bytes | bytearray) -> str:
    """Each byte that starts no whole character becomes one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[i : i + k]).decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, PieceCodec] = {}


@contextlib.contextmanager
def task_codec(model_file: str | None, keep: bool = False) -> Iterator[PieceCodec]:
    """The codec of this worker for one task; what it remembers of the task's texts goes with the task, unless later tasks are to ``keep`` it."""
    own = codec(model_file or default_model())
    own.runs.most = own.counts.most = _KEPT_CACHE if keep else _TASK_CACHE
    try:
        yield own
    finally:
        if not keep:
            own.runs.forget()
            own.counts.forget()
            own.fits.clear()


def codec(model_file: str) -> PieceCodec:
    """One codec per worker process and model."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _texts(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        yield batch, batch.column(batch.schema.get_field_index(text_col)).to_pylist()


def encode_texts(docs: DataFrame, model_file: str | None = None, text_col: str = "text", ids_col: str = "ids", bos: bool = True, eos: bool = True) -> DataFrame:
    """All columns of ``docs``, with the ids of the whole text in ``ids_col`` (a column of that name is replaced).

    Null and empty texts have only the begin and end ids; any text of any length is encoded whole; each row is on its own, so
    repeated rows and an empty table need no rule.
    """
    small_batches(docs.sparkSession)
    base = docs.drop(ids_col)
    schema = T.StructType([*base.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(model_file) as own:
            for batch, texts in _texts(batches, text_col):
                ids = pa.array([own.encode(t or "", bos, eos) for t in texts], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return base.mapInArrow(tidied(work), schema)


def decode_ids(table: DataFrame, model_file: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns, with the text of the ids in ``text_col``; null ids give a null text."""
    base = table.drop(text_col)
    schema = T.StructType([*base.schema.fields, T.StructField(text_col, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(model_file) as own:
            for batch, ids in _texts(batches, ids_col):
                text = pa.array([None if x is None else own.decode(x) for x in ids], type=pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, text_col])

    return base.mapInArrow(tidied(work), schema)


def round_trip(docs: DataFrame, model_file: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs``, with the ids of the whole text (begin and end included), their number ``n_tokens``, and ``round_trip``: whether
    decoding them gives the text again.  Columns of these names are refused; null and empty texts have the begin and end ids alone."""
    if clash := {ids_col, "n_tokens", "round_trip"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    small_batches(docs.sparkSession)
    more = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *more])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(model_file) as own:
            for batch, texts in _texts(batches, text_col):
                ids = [own.encode(t or "", True, True) for t in texts]
                same = [own.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int32()), pa.array(same)], names=schema.names)

    return docs.mapInArrow(tidied(work), schema)


def round_trip_digests(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of ids, and digests of the ids and of the text they decode to, without shipping the ids."""
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([base.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(model_file, keep=True) as own:
            for batch, texts in _texts(batches, "text"):
                rows = [own.digest(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                    names=schema.names,
                )

    return base.mapInArrow(tidied(work), schema)

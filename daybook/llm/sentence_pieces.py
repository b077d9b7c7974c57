"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model.

Method: backtracking. The encoder takes the longest piece that an Aho-Corasick
automaton matches at a place, and accepts it after the piece before only if the
two are compatible: merging their joined characters anew gives back exactly
these two. (The merges inside final pieces do not depend on what stands around
them, so a sequence is the merge result if and only if all neighbours are
compatible.) Where no piece fits, the encoder drops the last piece and tries the
next shorter one; a bit field keeps the places from which no encoding goes on,
so no place fails twice and time stays in proportion to the length.

No piece has a space mark behind another character, so no merge crosses from a
character to a space mark: texts are encoded run by run ("marks and a word"),
and runs met before come from a bounded cache.

Defined results: a null or empty text has no ids and decodes to the empty text;
characters without a piece become their UTF-8 byte pieces.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import whole_text

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CACHE_ROWS = 600_000


class PieceModel:
    """Pieces, scores and the automaton of one model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as spm

        proto = spm.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        kinds = {p.type for p in proto.pieces}
        if trainer.model_type != 2 or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or BYTE not in kinds:
            raise ValueError("a merge-type model with byte pieces and without pieces of the user's own is needed")
        if norm.precompiled_charsmap or not norm.escape_whitespaces or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or trainer.treat_whitespace_as_suffix:
            raise ValueError("a model with identity normalisation and a mark before the text is needed")
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}
        self.unknown = {i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN}
        self.surface = {str(i): p.replace(MARK, " ") for p, i in self.ids.items()}
        self.unknown_surface = trainer.unk_surface
        self.crosses = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.longest_piece = max(map(len, self.ids))
        self.compatible: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, list[str]] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: always the pair with the best score, of equal ones the leftmost."""
        part, score = list(text), self.scores
        n = len(part)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(-score[part[i] + part[i + 1]], i, i + 1, part[i] + part[i + 1]) for i in range(n - 1) if part[i] + part[i + 1] in score]
        heapq.heapify(queue)
        while queue:
            _, a, b, joined = heapq.heappop(queue)
            if not part[a] or not part[b] or right[a] != b or part[a] + part[b] != joined:
                continue
            part[a], part[b] = joined, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0 and y >= 0 and part[x] + part[y] in score:
                    heapq.heappush(queue, (-score[part[x] + part[y]], x, y, part[x] + part[y]))
        return [p for p in part if p]

    def _fits(self, a: str, b: str) -> bool:
        known = self.compatible.get((a, b))
        if known is None:
            known = self.merged(a + b) == [a, b]
            if len(self.compatible) >= 2_000_000:
                self.compatible.clear()
            self.compatible[(a, b)] = known
        return known

    def _prefixes(self, piece: str) -> list[str]:
        """The pieces that begin ``piece``, longest first; its first character always counts."""
        known = self.shorter.get(piece)
        if known is None:
            known = self.shorter[piece] = [piece[:n] for n in range(len(piece), 0, -1) if n == 1 or piece[:n] in self.ids]
        return known

    def pieces_of(self, run: str) -> list[str]:
        """The pieces of one run by backtracking."""
        longest, compatible, shorter, n, most = self.automaton.longest_prefix, self.compatible, self.shorter, len(run), self.longest_piece

        def reach(at: int) -> list[str]:
            # The automaton walks as far as any piece's beginning reaches; the longest whole piece lies within.
            piece = run[at : at + (longest(run[at : at + most]) or 1)]
            return shorter.get(piece) or self._prefixes(piece)

        failed = bytearray()  # bit i: nothing goes on from place i; made when the first place fails
        chosen: list[str] = []
        tries: list[tuple[int, Iterator[str]]] = [(0, iter(reach(0)))]
        while tries:
            at, left = tries[-1]
            for piece in left:
                end = at + len(piece)
                if failed and failed[end >> 3] >> (end & 7) & 1:
                    continue
                if chosen:
                    ok = compatible.get((chosen[-1], piece))
                    if ok is None:
                        ok = self._fits(chosen[-1], piece)
                else:
                    ok = len(piece) == 1 or self._whole(piece)
                if ok:
                    chosen.append(piece)
                    if end == n:
                        return chosen
                    tries.append((end, iter(reach(end))))
                    break
            else:
                failed = failed or bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                tries.pop()
                if chosen:
                    chosen.pop()
        raise AssertionError("merging always gives an encoding")

    def _whole(self, piece: str) -> bool:
        """Whether merging gives the piece as a whole (else it never ends a merge)."""
        known = self.compatible.get((piece, ""))
        if known is None:
            known = self.compatible[(piece, "")] = self.merged(piece) == [piece]
        return known

    def ids_of(self, run: str) -> list[int]:
        """Ids of one run; characters without a piece become byte pieces."""
        out: list[int] = []
        for piece in self.pieces_of(run):
            i = self.ids.get(piece)
            if i is None:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(i)
        return out

    def runs(self, text: str) -> list[str]:
        """The text with its mark in front, cut where no merge can cross."""
        marked = MARK + text.replace(" ", MARK)
        if self.crosses:
            return [marked]
        if MARK + MARK not in marked:
            return [MARK + x for x in marked.split(MARK)[1:]]
        return re.findall(f"{MARK}+[^{MARK}]*", marked)

    def encode(self, text: str) -> list[int]:
        return [i for run in self.runs(text) for i in self.ids_of(run)] if text else []

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces without the one in front, byte pieces as UTF-8 (bad bytes as U+FFFD), controls left out."""
        out, raw, first = [], bytearray(), True
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                first = False
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw = bytearray()
            if i is None or i in self.silent:
                continue
            piece = self.unknown_surface if i in self.unknown else self.pieces[i]
            if first and piece.startswith(MARK):
                piece = piece[1:]
            first = False
            out.append(piece.replace(MARK, " "))
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """Whole characters, and U+FFFD for each byte that belongs to none."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
            except UnicodeDecodeError:
                continue
            at += n
            break
        else:
            out.append("�")
            at += 1
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


class _Runs(dict):
    """Run -> (ids as text, number of ids, decoded); empties itself at its bound."""

    def __init__(self, m: PieceModel) -> None:
        super().__init__()
        self.m = m

    def __missing__(self, run: str) -> str:
        ids = self.m.ids_of(run)
        if len(self) >= CACHE_ROWS:
            self.clear()
        self[run] = out = ",".join(map(str, ids))
        return out


class _Decoded(dict):
    """A run's ids as text -> the run decoded from them; empties itself at its bound."""

    def __init__(self, m: PieceModel) -> None:
        super().__init__()
        self.m = m

    def __missing__(self, ids: str) -> str:
        if len(self) >= CACHE_ROWS:
            self.clear()
        names = ids.split(",")
        try:  # a run of plain pieces, the first of which begins with the mark
            out = "".join(map(self.m.surface.__getitem__, names))
        except KeyError:
            out = " " + self.m.decode(list(map(int, names)))
        self[ids] = out
        return out


#: By model file; they live as long as the Python worker, over its tasks.
_RUNS: dict[str, _Runs] = {}
_DECODED: dict[str, _Decoded] = {}


def encode_texts(documents: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``documents`` with the ids of each whole text."""

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        runs = _RUNS.setdefault(path, _Runs(model(path)))
        for texts in batches:
            yield pd.Series([list(map(int, ",".join(map(runs.__getitem__, runs.m.runs(t))).split(","))) if t else [] for t in texts])

    return documents.withColumn(into, F.pandas_udf(rows, "array<int>")(whole_text(text)))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of each list of ids; a null list gives the empty text."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(path)
        for lists in batches:
            yield pd.Series([m.decode([int(i) for i in x]) if x is not None else "" for x in lists], dtype=object)

    return rows.withColumn(into, F.pandas_udf(texts, "string")(F.col(ids)))


def digests(documents: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text the number of ids and SHA-256 of the ids (decimal, joined by commas) and of the text decoded from them."""

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model(path)
        runs = _RUNS.setdefault(path, _Runs(m))
        back = _DECODED.setdefault(path, _Decoded(m))
        for texts in batches:
            out = []
            for t in texts:
                parts = list(map(runs.__getitem__, m.runs(t))) if t else []
                ids = ",".join(parts)
                # A run begins with a mark, so runs decode one by one.
                decoded = "".join(map(back.__getitem__, parts))[1:]
                out.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    run = F.pandas_udf(rows, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return documents.select(F.col(id_col), run(whole_text(text)).alias("digest_row")).select(id_col, "digest_row.*")

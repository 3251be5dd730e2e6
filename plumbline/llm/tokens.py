"""Whole-text encoding with a public tokenizer through a bounded memo of pieces."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: White space that touches a space or a line end, or an end of the text.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
ODD = f"{BLANK}[ \n]|[ \n](?:{BLANK}|$)|^{BLANK}"


class Encoder:
    """Encodes texts with the tokenizers library; same ids as encoding each text at once.

    Byte-level tokenizers part a text before any single space between two visible characters, and those that drop
    white space part it at every space, so the pieces between such places can be encoded one by one. Each distinct
    piece is encoded once and kept in a memo of two generations of ``limit`` pieces at most; any other kind of
    tokenizer gets its texts whole. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str, limit: int = 50_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.limit, self.young, self.old = limit, {}, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        steps, parts = norm.get("normalizers", [norm]), pre.get("pretokenizers", [pre])
        blank = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " " for x in steps)
        self.mark, self.between = "", ""
        if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            # a line end before a space is a piece of its own
            self.pieces, self.mark, self.between = self._before_space, "\n", "\n"
        elif blank and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
            self.pieces, self.mark, self.between = self._at_space, "\x01", " \x01 "
        else:
            self.pieces = None
        mark = self.tokenizer.encode(self.mark, add_special_tokens=False).ids if self.mark else []
        self.mark_id = mark[0] if len(mark) == 1 else None
        self.lower = any(x.get("type") == "Lowercase" for x in steps)
        self.gap = re.compile(r" (?=\S)(?<=\S )")

    def _before_space(self) -> None:
        """Pieces from a text's second on stand without the space before them, unless they begin with a line end."""

    def _at_space(self) -> None:
        """Pieces are what stands between spaces and line ends."""

    def _lead(self, piece: str) -> str:
        """The piece with the space before it, where it has one."""
        return piece if self.mark != "\n" or piece[:1] == "\n" else " " + piece

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, missing: set[str]) -> None:
        """Encode what neither generation of the memo has, many short pieces at a time with a mark between them."""
        old, young, short, long, heads, ended = self.old, self.young, [], [], [], []
        for piece in list(missing):  # a mark after a letter is always parted from it
            if piece[-1:] in (".", ",") and piece[-2:-1].isalpha() and piece not in old:
                ended.append(piece)
                missing.discard(piece)
        missing.update(x for piece in ended for x in (piece[:-1],) if x not in young)
        for piece in missing:
            ids = old.get(piece)
            if ids is not None:
                young[piece] = ids
            elif self.mark_id is None or len(piece) > 200 or not piece.strip() or piece[-1].isspace():
                long.append(piece)
            elif piece[0] == self.mark == "\n" and piece.count("\n") == 1 and not piece[1].isspace():
                heads.append(piece)
            elif self.mark in piece or piece[0].isspace():
                long.append(piece)
            else:
                short.append(piece)
        lead = self._lead
        young.update(zip(long, self._whole([lead(x) for x in long])))
        self._joined([lead(x) for x in short], short, self.between, 0)
        self._joined(heads, heads, "", 1)
        marks = dict(zip(".,", self._whole([".", ","])))
        for piece in ended:
            young[piece] = young[piece[:-1]] + marks[piece[-1]]

    def _joined(self, shown: list[str], pieces: list[str], between: str, headed: int) -> None:
        """Encode many pieces at once, parted by the mark's id, with which each of them begins if ``headed``."""
        step = range(0, len(pieces), 64)
        many = self.tokenizer.encode_batch_fast([between.join(shown[i : i + 64]) for i in step], add_special_tokens=False)
        for i, got in zip(step, many):
            group, raw = pieces[i : i + 64], array("I", got.ids)
            data = raw.tobytes()
            cuts = [k for k, x in enumerate(raw) if x == self.mark_id]
            if len(cuts) != len(group) - 1 + headed:
                self.young.update(zip(group, self._whole(shown[i : i + 64])))
            elif headed:
                self.young.update((p, data[4 * a : 4 * b]) for p, a, b in zip(group, cuts, [*cuts[1:], len(raw)]))
            else:
                self.young.update((p, data[4 * a + 4 : 4 * b]) for p, a, b in zip(group, [-1, *cuts], [*cuts, len(raw)]))

    def encode_column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after the other, and where each text's ids end; null counts as empty.

        Arrow parts the texts and numbers the distinct pieces, so Python handles each of a batch's pieces once.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.pieces == self._before_space:
            whole = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        elif self.pieces == self._at_space:
            whole = np.zeros(len(texts), dtype=bool)
            split = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts) if self.lower else texts, "\n", " "), " ")
        else:
            whole = np.ones(len(texts), dtype=bool)
            split = pc.split_pattern(texts, "\x00", max_splits=0)
        firsts = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        code, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        values = self._known(pieces)
        if self.pieces != self._at_space:  # the first piece stands without a space; odd texts are done as a whole
            plain = [x.as_py() for x in pc.list_element(split, 0)] if len(texts) else []
            odd = [b"".join(self._odd(x.as_py())) for x in texts.filter(pa.array(whole))]
            heads = self._whole(plain)
            for i, ids in zip(np.flatnonzero(whole), odd):
                heads[i] = ids
            code[firsts[:-1]] = len(values) + np.arange(len(texts))
            values = values + heads
            kept = np.ones(len(code), dtype=bool)
            for i in np.flatnonzero(whole):
                kept[firsts[i] + 1 : firsts[i + 1]] = False
        else:
            kept = None
        lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) >> 2
        starts = np.cumsum(lengths) - lengths
        table = np.frombuffer(b"".join(values), dtype="<u4")
        size = lengths[code] if kept is None else np.where(kept, lengths[code], 0)
        after = np.cumsum(size)
        ids = table[np.repeat(starts[code] - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)]
        ends = np.concatenate([[0], after])[firsts[1:]]
        if end is not None:
            ids = np.insert(ids, ends, end)
            ends = ends + np.arange(1, len(ends) + 1)
        return ids, ends

    def _known(self, pieces: list[str]) -> list[bytes]:
        get = self.young.get
        got = list(map(get, pieces))
        if None in got:
            self._learn({p for p, x in zip(pieces, got) if x is None})
            got = list(map(get, pieces))
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return got

    def _odd(self, text: str) -> list[bytes]:
        """A text with neighbouring white space, parted only where that is safe."""
        if self.pieces != self._before_space:
            return self._whole([text])
        first, *rest = self.gap.split(text)
        return [*self._whole([first]), *self._known(rest)]

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers, with the id ``end`` after them if given."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()), end)
        return np.split(ids, ends[:-1]) if len(ends) else []


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for ``path``."""
    return kept(("encoder", path), lambda: Encoder(path))

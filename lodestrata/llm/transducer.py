"""A tokenizer compiled into a deterministic transducer that counts tokens.

Inside a run of letters, digits or other signs the machine of ``machine`` goes from state to state
by one byte at a time; its transitions are annotated with the change in the number of tokens. The
end of a run closes the last token and leads back to the first state, and so does white space,
which the vocabulary's normaliser drops and its pre-tokenizer never joins across. The path of a unit between two
white-space characters is kept as one arc, annotated with what it emits; those of units that recur are kept. The library
only normalises and cuts units with signs beyond plain ones; it encodes none.

A piece of text maps each entry state to (exit state, tokens emitted). As every white-space
character leads to the first state, that map is (head, count, tail): the text before the first
white space, which joins what came before, the tokens between, and the text after the last.
Maps of adjacent pieces compose associatively, so pieces of a long text are mapped in
parallel and combined by a scan.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from lodestrata.llm.machine import Machine

# The pre-tokenizer's pattern, and white space as the library sees it.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Arrow's split also cuts at these; the library does not.
CONTROLS = "[\x1c-\x1f]"
#: Units of these characters need no normaliser but lower-casing: nothing composes in them.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017e]+")
#: Arcs kept in one worker process.
ARCS = 200_000
#: Fixed value, the letters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in SHOWN)}


def split(texts: pa.Array) -> pa.ListArray:
    """The units of texts: what lies between white space."""
    if pc.any(pc.match_substring_regex(texts, CONTROLS)).as_py():
        return pa.array([SPACE.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(texts)


class Transducer:
    """Arcs: unit -> its number of tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.machine = Machine(spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]])
        self.arcs: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def runs(self, unit: str) -> list[str | int]:
        """The runs of a unit in letters of bytes; a special token stands as its id."""
        if PLAIN.fullmatch(unit) and "<|" not in unit:
            low = unit.lower()
            runs = [low] if unit.isalpha() else PIECES.findall(low)
            return runs if unit.isascii() else [r.encode().decode("latin-1").translate(LETTERS) for r in runs]
        out: list[str | int] = []
        for part in self.specials.split(unit) if self.specials else [unit]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [r for r, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def compile(self, unit: str) -> int:
        """The arc of a unit: the tokens of its runs, added up."""
        known, total = self.known, 0
        for run in self.runs(unit):
            n = 1 if isinstance(run, int) else known.get(run)
            if n is None:
                if len(known) >= ARCS:
                    known.clear()
                n = known[run] = self.machine.count(run)
            total += n
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; no text is null."""
        lists = split(texts)
        steps = lists.flatten().dictionary_encode()
        units, at = steps.dictionary.to_pylist(), np.asarray(steps.indices)
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        arcs = self.arcs
        found = [arcs.get(u) for u in units]
        often = np.bincount(at, minlength=len(units)) > 1
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self.compile(units[i])
            if often[i] and len(arcs) < ARCS:
                arcs[units[i]] = found[i]
        total = np.concatenate([[0], np.cumsum(np.array(found, dtype=np.int64)[at])])
        return total[bounds[1:]] - total[bounds[:-1]]

    def chunk_map(self, piece: str) -> tuple[str, int | None, str]:
        """(head, count, tail) of a piece; count is null if it holds no white space (then all is head)."""
        return self.chunk_maps([piece])[0]

    def chunk_maps(self, pieces: list[str]) -> list[tuple[str, int | None, str]]:
        inner, out = [], []
        for p in pieces:
            first = SPACE.search(p)
            if not first:
                out.append((p, None, ""))
                inner.append("")
                continue
            last = len(p) - len(SPACE.split(p[::-1], maxsplit=1)[0])
            out.append((p[: first.start()], 0, p[last:]))
            inner.append(p[first.start() : last])
        counts = self.counts(pa.array(inner, pa.string())).tolist()
        return [(h, None if n is None else c, t) for (h, n, t), c in zip(out, counts, strict=True)]

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        """The map of two adjacent pieces."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + int(self.counts(pa.array([a[2] + b[0]]))[0]) + b[1], b[2]

    def total(self, m: tuple[str, int | None, str]) -> int:
        """Tokens of a text whose map is ``m``, entered and left in the state "outside"."""
        return (m[1] or 0) + int(self.counts(pa.array([m[0], m[2]])).sum())


_LOADED: dict[str, Transducer] = {}


def path_of(name: str) -> str:
    """The file of a vocabulary: a path, or a name that ``public_tokenizers`` resolves."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str) -> Transducer:
    """The transducer of a vocabulary, once a process."""
    if name not in _LOADED:
        _LOADED[name] = Transducer(path_of(name))
    return _LOADED[name]

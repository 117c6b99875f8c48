"""Token ids of whole texts by the tokenizer library, each distinct unit between white space once a batch."""

from __future__ import annotations

import os
from itertools import pairwise

import numpy as np
import pyarrow as pa

from lodestrata.llm.transducer import PIECES, PLAIN, path_of, split

#: Units and runs kept in one worker process.
UNITS = 200_000
WORD_END = "</w>"


class Encoder:
    """Ids by the tokenizer library, as little-endian unsigned 32-bit bytes; those of units that recur are kept."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.units: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def encode(self, units: list[str]) -> dict[str, bytes]:
        """The ids of ``units``. A plain one is the sum of its runs; new runs are encoded together and parted at the tokens that end them."""
        out: dict[str, bytes] = {}
        parted: dict[str, list[str] | str] = {}
        odd = []
        for u in units:
            if not PLAIN.fullmatch(u) or "<|" in u:
                odd.append(u)
            else:
                parted[u] = low = u.lower()
                if not u.isalpha():
                    parted[u] = PIECES.findall(low)
        if odd:
            out.update(zip(odd, [x.tobytes() for x in self._encode(odd)], strict=True))
        known, fresh = self.runs, {}
        for runs in parted.values():
            for r in (runs,) if isinstance(runs, str) else runs:
                if r not in known:
                    fresh[r] = fresh.get(r, 0) + 1
        if fresh:
            ids = self._encode([" ".join(fresh)])[0]
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            made = dict(zip(fresh, [data[i:j] for i, j in zip([0, *stops], stops, strict=False)], strict=True))
            if len(known) < UNITS:
                known.update((r, made[r]) for r, n in fresh.items() if n > 1)
        else:
            made = {}
        for u, runs in parted.items():
            if isinstance(runs, str):
                out[u] = known[runs] if runs in known else made[runs]
            else:
                out[u] = b"".join([known[r] if r in known else made[r] for r in runs])
        return out

    def walk(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Run over texts without nulls: (ids of the distinct units, the unit at each step, first step of each text and the end)."""
        lists = split(texts)
        steps = lists.flatten().dictionary_encode()
        units, at = steps.dictionary.to_pylist(), np.asarray(steps.indices)
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        kept = self.units
        ids = [kept.get(u) for u in units]
        gaps = [i for i, x in enumerate(ids) if x is None]
        made = self.encode([units[i] for i in gaps])
        often = np.bincount(at, minlength=len(units)) > 1
        for i in gaps:
            ids[i] = made[units[i]]
            if often[i] and len(kept) < UNITS:
                kept[units[i]] = ids[i]
        return ids, at, bounds

    def emit(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, as bytes."""
        ids, at, bounds = self.walk(texts)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first = np.cumsum(size) - size
        each = size[at]
        total = np.concatenate([[0], np.cumsum(each)])
        where = np.repeat(first[at] - total[:-1], each) + np.arange(total[-1])
        data = np.frombuffer(b"".join(ids), dtype="<u4")[where].tobytes()
        ends = (4 * total[bounds]).tolist()
        return [data[i:j] for i, j in pairwise(ends)]


_LOADED: dict[str, Encoder] = {}


def load(name: str) -> Encoder:
    """The encoder of a vocabulary (a path, or a name that ``public_tokenizers`` resolves), once a process."""
    if name not in _LOADED:
        _LOADED[name] = Encoder(path_of(name))
    return _LOADED[name]

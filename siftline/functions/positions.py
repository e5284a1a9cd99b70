"""The normal form for matching with a map back: where each of its characters stands in the text as it came."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np
import regex

from siftline.functions.matching import HIDDEN

BLANK = np.array([bool(regex.match(r"\s", chr(c))) for c in range(0x3001)])


class NormMap(NamedTuple):
    """text is the normal form; its character k stands at start[k] to stop[k] of the source."""

    text: str
    start: np.ndarray
    stop: np.ndarray

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The span of the source that characters a to b of the normal form stand for."""
        if a >= b:
            at = int(self.start[a]) if a < len(self.start) else int(self.stop[-1]) if len(self.stop) else 0
            return at, at
        return int(self.start[a]), int(self.stop[b - 1])


def composed(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """NFC with each character's place: of one cluster where nothing changed in it, else the whole cluster."""
    if unicodedata.is_normalized("NFC", text):
        at = np.arange(len(text))
        return text, at, at + 1
    whole = unicodedata.normalize("NFC", text)
    for parts in (regex.findall(r"\X", text), regex.findall(r"\s+|\S+", text)):  # composition rarely crosses clusters, never white space
        out, start, stop, at = [], [], [], 0
        for part in parts:
            short = unicodedata.normalize("NFC", part)
            if short == part:
                start += range(at, at + len(part))
                stop += range(at + 1, at + len(part) + 1)
            else:
                start += [at] * len(short)
                stop += [at + len(part)] * len(short)
            out.append(short)
            at += len(part)
        if "".join(out) == whole:
            break
    return whole, np.array(start), np.array(stop)


def norm_map(text: str | None) -> NormMap:
    """The same text as matching.matched, with the map: composed, hidden marks out, ASCII lower case, white space to single blanks."""
    whole, start, stop = composed(text or "")
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    seen = ~np.isin(code, list(HIDDEN))
    code, start, stop = code[seen], start[seen], stop[seen]
    blank = BLANK[np.minimum(code, len(BLANK) - 1)] & (code < len(BLANK))
    first = ~(blank & np.concatenate([[True], blank[:-1]])) if len(code) else np.zeros(0, bool)
    if len(code) and blank[-1]:  # white space at the end goes with the run that ends there
        last = np.flatnonzero(~blank)
        first[last[-1] + 1 if len(last) else 0 :] = False
    code, start, stop, blank = code[first], start[first], stop[first], blank[first]
    upper = (code >= 65) & (code <= 90)
    code = np.where(blank, 32, code + np.where(upper, 32, 0)).astype(np.uint32)
    return NormMap(code.tobytes().decode("utf-32-le"), start, stop)

"""BagMinHash signatures of weighted sets, vectorised over many documents.

An element of weight w owns the discretised weights 0 to w-1. They are grouped
in intervals [0,1), [1,2), [2,4), [4,8) ...; each interval has a Poisson process
whose rate is its length and whose points come from hashes of the element, the
interval and the point's number. A point has a place in its interval, and counts
if its weight is below w: two sets thus share a point if and only if both
weights exceed it. Every point falls on one of ``m`` components, and a
component's value is its earliest point. Two sets agree in a component with a
probability of exactly their weighted Jaccard similarity.

Points are drawn in rising time, only up to the time by which all components are
sure to have one; a set for which that fails draws again up to twice the time.
"""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _intervals(doc: np.ndarray, element: np.ndarray, weight: np.ndarray):
    """One row per element and interval that begins below its weight."""
    rows = [(doc, element, np.zeros(len(doc), "int64"), np.ones(len(doc), "int64"), weight)]
    lower, level = 1, 1
    on = weight > lower
    while on.any():
        doc, element, weight = doc[on], element[on], weight[on]
        rows.append((doc, mix(element ^ np.uint64(level * 0x5851F42D4C957F2D % 2**64)),
                     np.full(len(doc), lower), np.full(len(doc), lower), weight))
        lower, level = 2 * lower, level + 1
        on = weight > lower
    return [np.concatenate(c) for c in zip(*rows)]


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) hashes of the earliest points. ``doc``: 0 to n_docs-1 for each element; each has one or more."""
    total = np.bincount(doc, weight, n_docs)
    until = m * (np.log(m) + 3) / np.maximum(total, 1)
    out = np.zeros((n_docs, m), "uint64")
    todo = np.arange(n_docs)
    while len(todo):
        sig, full = _drawn(doc, element, weight, n_docs, m, until)
        out[todo[full[todo]]] = sig[todo[full[todo]]]
        todo = todo[~full[todo]]
        if len(todo):
            until = until * 2
            left = np.zeros(n_docs, bool)
            left[todo] = True
            on = left[doc]
            doc, element, weight = doc[on], element[on], weight[on]
    return out


def _drawn(doc, element, weight, n_docs: int, m: int, until: np.ndarray):
    doc, element, lower, length, weight = _intervals(doc, element, weight)
    time, inside = np.zeros(len(doc)), weight - lower
    rate, end = length.astype(float), until[doc]
    keys, times, ids = [], [], []
    n = 0
    while len(doc):
        n += 1
        point = mix(element + np.uint64(n * 0xD1342543DE82EF95 % 2**64))
        time = time - np.log(((point >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        on = time < end
        if not on.all():
            doc, element, time, inside, length, rate, end, point = (
                x[on] for x in (doc, element, time, inside, length, rate, end, point))
        place = mix(point)
        counts = ((place & _LOW).astype("int64") * length >> 32) < inside
        keys.append((doc * m + ((place >> np.uint64(32)) % np.uint64(m)).astype("int64"))[counts])
        times.append(time[counts])
        ids.append(point[counts])
    key, time, point = np.concatenate(keys), np.concatenate(times), np.concatenate(ids)
    best = np.full(n_docs * m, np.inf)
    np.minimum.at(best, key, time)
    first = time == best[key]
    sig = np.zeros(n_docs * m, "uint64")
    sig[key[first]] = point[first]
    return sig.reshape(n_docs, m), np.isfinite(best).reshape(n_docs, m).all(axis=1)


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """(n_docs, m / rows) hashes of ``rows`` components each, different for each band."""
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(m // rows, dtype="uint64"), parts.shape[:2]).copy()
    for r in range(rows):
        out = mix(out ^ parts[:, :, r])
    return out

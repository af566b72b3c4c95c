"""Term statistics of tokenised documents: sorted codes in numpy, side by side for all documents of a batch."""

from __future__ import annotations

import unicodedata
from collections.abc import Set

import numpy as np
import pyarrow as pa

from paperloom.functions.similar import dissimilar_members

TOKENS = 1 << 18  # tokens that are counted at once, or one document
TERM_FEATURES = {
    "term": "string", "tf": "bigint", "tf_upper": "bigint", "tf_acronym": "bigint", "n_sentences": "int",
    "median_sentence": "double", "last_sentence": "int", "n_left": "bigint", "n_right": "bigint", "d_left": "int", "d_right": "int",
    "is_stop": "boolean", "max_tf": "bigint", "typical_tf": "double", "all_sentences": "int",
}
TOTALS = ("max_tf", "typical_tf", "all_sentences")  # of the document: largest tf, mean and deviation of content terms, sentences
RANKED = "array<struct<score:double,term:string>>"
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
_SCORE_UNITS = 1e12  # scores have 12 digits


def _lengths(lists: pa.Array) -> np.ndarray:
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _is_number(term: str) -> bool:
    return all(c in ".," or unicodedata.category(c)[0] == "N" for c in term)


def _casing(token: str) -> int:
    """2: two or more upper-case letters and nothing else, 1: any other word with a capital, 0: the rest."""
    if unicodedata.category(token[0]) != "Lu":
        return 0
    return 2 if len(token) > 1 and all(unicodedata.category(c) == "Lu" for c in token) else 1


def _distinct(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs in order; values are not negative."""
    width = int(value.max(initial=0)) + 1
    pairs = np.sort(group * width + value)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return pairs // width, pairs % width


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of ``key`` (not negative) in its order, equal ones as they come, and the sorted key."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) >> (62 - bits):
        order = key.argsort(kind="stable")
        return order, key[order]
    both = np.sort((key << bits) | np.arange(len(key)))  # faster than to sort places
    return both & ((1 << bits) - 1), both >> bits


def _totals(documents: int, document: np.ndarray, tf: np.ndarray, last: np.ndarray, stop: np.ndarray) -> dict[str, np.ndarray]:
    """``TOTALS`` by term; terms are in order of their document."""
    most, end = np.zeros(documents, np.int64), np.zeros(documents, np.int64)
    np.maximum.at(most, document, tf)
    np.maximum.at(end, document, last)
    of, content = document[~stop], tf[~stop].astype(float)
    count = np.maximum(np.bincount(of, minlength=documents), 1)
    mean = np.bincount(of, content, documents) / count
    spread = np.sqrt(np.bincount(of, (content - mean[of]) ** 2, documents) / count)
    return {name: value[document] for name, value in zip(TOTALS, (most, mean + spread, end + 1))}


def _features(documents: pa.Array, stop_words: Set[str]) -> tuple[np.ndarray, np.ndarray, list[str], dict[str, np.ndarray]]:
    """(document, place among the names, features but the name) by term, and the names in order.  Terms are in order of document and name."""
    per_document, sentences = _lengths(documents), documents.flatten()
    numbers, tokens = sentences.flatten()[:2]
    per_sentence = _lengths(tokens)
    document = np.repeat(np.repeat(np.arange(len(documents)), per_document), per_sentence)
    sentence = np.repeat(numbers.to_numpy(zero_copy_only=False).astype(np.int64), per_sentence)
    coded = tokens.flatten().dictionary_encode()
    token, spelled = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    lower = [word.lower() for word in spelled]
    names = sorted(set(lower))
    place = {name: at for at, name in enumerate(names)}
    term = np.fromiter(map(place.__getitem__, lower), np.int64, len(lower))[token]
    casing = np.array([0 if "a" <= word[0] <= "z" else _casing(word) for word in spelled], np.int8)[token]
    number = np.array([not name[0].isalpha() and _is_number(name) for name in names], bool)[term]
    stop = np.array([len(name) < 3 or name in stop_words for name in names], bool)

    ends = np.cumsum(per_sentence)[per_sentence > 0]
    first, last = np.zeros(len(term), bool), np.zeros(len(term), bool)
    first[ends - per_sentence[per_sentence > 0]], last[ends - 1] = True, True
    beside = {"left": np.where(first, -1, np.roll(term, 1)), "right": np.where(last, -1, np.roll(term, -1))}

    kept = np.flatnonzero(~number)
    order, key = _ordered(document[kept] * max(1, len(names)) + term[kept])
    kept = kept[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    groups = len(starts)
    group = np.repeat(np.arange(groups), np.diff(np.append(starts, len(key))))

    def count(chosen: np.ndarray) -> np.ndarray:
        return np.bincount(group[chosen], minlength=groups)

    out = {"tf": np.diff(np.append(starts, len(key)))}
    out |= {"tf_upper": count((casing[kept] == 1) & ~first[kept]), "tf_acronym": count(casing[kept] == 2)}
    of, at = _distinct(group, sentence[kept])
    size = np.bincount(of, minlength=groups)
    end = np.cumsum(size)
    begin = end - size
    out |= {"n_sentences": size, "median_sentence": (at[begin + (size + 1) // 2 - 1] + at[begin + size // 2]) / 2, "last_sentence": at[end - 1]}
    for side, terms_beside in beside.items():
        there = terms_beside[kept] >= 0
        out |= {f"n_{side}": count(there), f"d_{side}": np.bincount(_distinct(group[there], terms_beside[kept][there])[0], minlength=groups)}
    of, code = document[kept[starts]], term[kept[starts]]
    out["is_stop"] = stop[code]
    out |= _totals(len(documents), of, out["tf"], out["last_sentence"], out["is_stop"])
    return of, code, names, out


def _counted(documents: pa.Array, stop_words: Set[str]) -> pa.Array:
    of, code, names, out = _features(documents, stop_words)
    out["term"] = pa.array(names, pa.string()).take(pa.array(code))
    fields = [pa.array(out[name], _ARROW[kind]) if name != "term" else out[name] for name, kind in TERM_FEATURES.items()]
    offsets = np.searchsorted(of, np.arange(len(documents) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, list(TERM_FEATURES)))


def _score(f: dict[str, np.ndarray]) -> np.ndarray:
    """The score of content terms; smaller is better."""
    casing = np.maximum(f["tf_upper"], f["tf_acronym"]) / (1 + np.log(f["tf"]))
    position = np.log(np.log(3 + f["median_sentence"]))
    frequency = f["tf"] / f["typical_tf"]
    spread = f["n_sentences"] / f["all_sentences"]
    diversity = f["d_left"] / np.maximum(f["n_left"], 1) + f["d_right"] / np.maximum(f["n_right"], 1)
    relatedness = 1 + diversity * f["tf"] / f["max_tf"]
    weight = (relatedness * position) / (casing + frequency / relatedness + spread / relatedness)
    return weight / ((1 + weight) * f["tf"])


def _best(documents: pa.Array, stop_words: Set[str], limit: float, top: int) -> pa.Array:
    of, code, names, out = _features(documents, stop_words)
    content = np.flatnonzero(~out.pop("is_stop"))
    of, code = of[content], code[content]
    score = np.floor(_score({name: values[content] for name, values in out.items()}) * _SCORE_UNITS + 0.5)
    order = np.lexsort((score, of))  # terms of equal score stay in their order
    of, code, score = of[order], code[order], score[order] / _SCORE_UNITS
    taken = dissimilar_members(names, code, np.searchsorted(of, np.arange(len(documents) + 1)), limit, top)
    offsets = np.searchsorted(of[taken], np.arange(len(documents) + 1))
    terms = pa.array(names, pa.string()).take(pa.array(code[taken]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(score[taken]), terms], ["score", "term"]))


def _in_parts(documents: pa.Array, make) -> pa.Array:
    """``make`` of at most ``TOKENS`` tokens of documents at a time, or one document."""
    tokens = _lengths(documents.flatten().field("tokens") if len(documents) else documents)
    owner = np.repeat(np.arange(len(documents)), _lengths(documents))
    before = np.cumsum(np.bincount(owner, tokens, len(documents))) if len(documents) else np.zeros(0)
    cuts = np.flatnonzero(np.diff(before // TOKENS)) + 1
    return pa.concat_arrays([make(documents.slice(a, b - a)) for a, b in zip([0, *cuts], [*cuts, len(documents)])])


def term_features(documents: pa.Array, stop_words: Set[str]) -> pa.Array:
    """Per document its terms with ``TERM_FEATURES``; a document is a list of sentences (number, tokens)."""
    return _in_parts(documents, lambda part: _counted(part, stop_words))


def best_terms(documents: pa.Array, stop_words: Set[str], limit: float, top: int) -> pa.Array:
    """Per document its ``top`` best scored content terms (``RANKED``), without those too similar to a better one."""
    return _in_parts(documents, lambda part: _best(part, stop_words, limit, top))

"""License scans by patience alignment of words.

A text is aligned with a license template word by word: words that are unique both in the text and in
the template are anchors, the longest increasing subsequence of them is kept, and the gaps between
are aligned again by the same rule; equal words next to an anchor or a gap's border extend it.
Coverage is the share of the template's words that are aligned. Because words outside a template can
never align, each text is reduced to the template's words first, and a text whose word counts
cannot reach ``MIN_COVERAGE`` is left out before any alignment; both change no result.

An alignment spans at most ``STRETCH`` template lengths of the text's own words, so that words far apart are no notice. The
alignment of the whole text by anchors comes first. It misses a notice that the text has several times, or next to more of its
words, for these are not unique. Then each occurrence of the template's rarest words is taken as the anchor,
so many of them that no better alignment can do without all, and what stands before and after it is aligned with the
most words in the least span. So the coverage is the largest that any stretch of that length gives, at every size.

The templates are a small list (a parameter; ``MAX_TEMPLATE_WORDS`` is checked), sent to every task.

Defined results: null and empty texts have no license; templates without words are ignored; repeated rows
are scanned each; of equal coverage the longer template, then the one whose name sorts first, is the text's
license."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import ALNUM, Texts, slices, texts_of

MIN_COVERAGE = 0.8
STRETCH = 3
MAX_TEMPLATE_WORDS = 200_000
#: License notices as their authors ask to write them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "All-Rights-Reserved": "All rights reserved",
}


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two word sequences."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            out.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            out.append((hi_a, hi_b))
        if lo_a >= hi_a or lo_b >= hi_b:
            continue
        once_a, once_b = _unique(a, lo_a, hi_a), _unique(b, lo_b, hi_b)
        anchors = sorted((once_a[w], once_b[w]) for w in once_a.keys() & once_b.keys())
        chain = _increasing(anchors)
        before = (lo_a - 1, lo_b - 1)
        for x in [*chain, (hi_a, hi_b)] if chain else ():
            todo.append((before[0] + 1, x[0], before[1] + 1, x[1]))
            before = x
        out += chain
    return sorted(out)


def _unique(x: list[int], lo: int, hi: int) -> dict[int, int]:
    at: dict[int, int] = {}
    many = set()
    for i in range(lo, hi):
        if x[i] in at:
            many.add(x[i])
        at[x[i]] = i
    return {w: i for w, i in at.items() if w not in many}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence increasing in the second number (patience piles)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _densest(pairs: list[tuple[int, int]], pos: list[int], width: int) -> tuple[int, int, int]:
    """(aligned words, first word, end word) of the aligned pairs within ``width`` words that are most."""
    best, lo = (0, 0, 0), 0
    for hi, (k, _) in enumerate(pairs):
        while pos[k] - pos[pairs[lo][0]] >= width:
            lo += 1
        if hi - lo + 1 > best[0]:
            best = (hi - lo + 1, pos[pairs[lo][0]], pos[k] + 1)
    return best


def _dense(seq: list[int], pos: list[int], need: dict[int, int], width: int, least: int) -> list[int]:
    """Places in ``seq`` that lie in ``width`` words which hold ``least`` words of the template, in any order."""
    out: list[int] = []
    has = dict.fromkeys(need, 0)
    lo = n = 0
    for hi, w in enumerate(seq):
        has[w] += 1
        n += has[w] <= need[w]
        while pos[hi] - pos[lo] >= width:
            n -= has[seq[lo]] <= need[seq[lo]]
            has[seq[lo]] -= 1
            lo += 1
        if n >= least:
            out.extend(range(max(lo, out[-1] + 1 if out else 0), hi + 1))
    return out


def _gains(words, far, masks: dict[int, int], skip: int, n: int, width: int) -> list[int]:
    """The distance at which 1, 2, ... of the template's ``n`` words after its first ``skip`` can be aligned (bits that are
    cleared in one number count the longest common subsequence)."""
    full = (1 << n) - 1
    open_, out = full, []
    for w, d in zip(words, far, strict=True):
        if d >= width or len(out) == n:
            break
        hit = open_ & (masks[w] >> skip)
        if hit:
            open_ = ((open_ + hit) | (open_ - hit)) & full
            if n - open_.bit_count() > len(out):
                out.append(d)
    return out


def best_stretch(seq: list[int], pos: list[int], code: list[int], least: int) -> tuple[int, int, int]:
    """(aligned words, first word, end word) of the stretch of a text that aligns most words of the template;
    (0, 0, 0) if none has ``least``. ``pos`` are the places of ``seq`` in the text."""
    n, width = len(code), max(STRETCH * len(code), 8)
    best = _densest(align(seq, code), pos, width)
    if best[0] == n:
        return best
    need: dict[int, int] = {}
    ahead: dict[int, int] = {}
    back: dict[int, int] = {}
    at: dict[int, list[int]] = {}
    for j, w in enumerate(code):
        need[w] = need.get(w, 0) + 1
        at.setdefault(w, []).append(j)
        ahead[w] = ahead.get(w, 0) | 1 << j
        back[w] = back.get(w, 0) | 1 << (n - 1 - j)
    places = _dense(seq, pos, need, width, max(least, best[0] + 1))
    found: dict[int, list[int]] = {w: [] for w in need}
    for k in places:
        found[seq[k]].append(k)
    held = 0
    for w in sorted(need, key=lambda x: (len(found[x]), x)):
        # a better alignment leaves out fewer than n - best words, so it has one of any n - best
        if held >= n - max(best[0], least - 1):
            break
        held += need[w]
        for k in found[w]:
            lo, hi = bisect_right(pos, pos[k] - width), bisect_left(pos, pos[k] + width)
            for j in at[w]:
                after = [0, *_gains(seq[k + 1:hi], (x - pos[k] for x in pos[k + 1:hi]), ahead, j + 1, n - j - 1, width)]
                if j + len(after) <= best[0]:
                    continue
                before = [0, *_gains(seq[lo:k][::-1], (pos[k] - x for x in pos[lo:k][::-1]), back, n - j, j, width)]
                if len(before) + len(after) - 1 <= best[0]:
                    continue
                ends = [bisect_right(after, width - 1 - d) - 1 for d in before]
                most, short, d = max((g + h + 1, -d - after[h], d) for g, (d, h) in enumerate(zip(before, ends, strict=True)))
                if most > best[0]:
                    best = (most, pos[k] - d, pos[k] - short - d + 1)
            if best[0] == n:
                return best
    return best if best[0] >= least else (0, 0, 0)


def _template_words(templates: dict[str, str]) -> list[tuple[str, np.ndarray]]:
    t = texts_of(pa.array(list(templates.values()), pa.string()))
    s, e = t.words(ALNUM)
    h, own = t.hashes(s, e), t.text_of(s)
    return [(name, h[own == i]) for i, name in enumerate(templates) if (own == i).any()]


def scan_texts(t: Texts, templates: list[tuple[str, np.ndarray]], least: float) -> list[list[tuple[str, float, int, int]]]:
    """Per text: (template, coverage, first word, end word) of every template that reaches ``least``."""
    s, e = t.words(ALNUM)
    h, own = t.hashes(s, e), t.text_of(s)
    vocab = np.unique(np.concatenate([w for _, w in templates])) if templates else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0))
    known = vocab[at] == h if len(vocab) and len(h) else np.zeros(len(h), bool)
    place, num = np.flatnonzero(known), at[known]
    doc = own[place]
    begin = np.searchsorted(own, np.arange(t.n))
    out: list[list[tuple[str, float, int, int]]] = [[] for _ in range(t.n)]
    for name, words in templates:
        code = np.searchsorted(vocab, words)
        need: dict[int, int] = {}
        for c in code.tolist():
            need[c] = need.get(c, 0) + 1
        mine = np.isin(num, list(need))
        p, x, d = place[mine], num[mine], doc[mine]
        bound = np.zeros(t.n)  # words of the template that the text has at all
        for c, k in need.items():
            bound += np.minimum(np.bincount(d[x == c], minlength=t.n), k)
        enough = max(1, ceil(least * len(code) - 1e-9))
        for i in np.flatnonzero(bound >= enough).tolist():
            lo, hi = np.searchsorted(d, i), np.searchsorted(d, i + 1)
            seq, pos = x[lo:hi].tolist(), (p[lo:hi] - begin[i]).tolist()
            got, first, end = best_stretch(seq, pos, code.tolist(), enough)
            if got:
                out[i].append((name, got / len(code), first, end))
    return out


FOUND = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = MIN_COVERAGE) -> DataFrame:
    """doc_id and ``found`` (license, coverage, first_word, end_word), best first, for every row of ``docs``."""
    words = _template_words({k: templates[k] for k in sorted(templates)})
    if sum(len(w) for _, w in words) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words: scan them in several calls")
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        long = {name: len(w) for name, w in sent.value}
        for b, t in slices(batches):
            found = [[dict(zip(("license", "coverage", "first_word", "end_word"), x, strict=True))
                      for x in sorted(r, key=lambda y: (-y[1], -long[y[0]], y[0]))] for r in scan_texts(t, sent.value, least)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(found, pa.list_(FOUND))], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, found array<struct<license:string,coverage:double,first_word:long,end_word:long>>")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.get("found", F.lit(0))["license"].alias("license"),
                        F.round(F.get("found", F.lit(0))["coverage"], 6).alias("coverage"),
                        F.get("found", F.lit(0))["first_word"].alias("first_word"), F.get("found", F.lit(0))["end_word"].alias("end_word"))

"""Licence notices and texts by Dice coefficient over word bigrams, against templates of licence lines and whole texts.

Segments (lines and sentences, and the whole text) are normalised to lower-case runs of a-z and 0-9.  With a and b
distinct bigrams, Dice = 2 |both| / (a + b) is at least ``least`` only if a is between b * least / (2 - least) and
its inverse: templates outside of the bounds are not compared.

Whole licence texts, headers and their first sentences (``license_texts``) are compared with every window of words,
however lines are wrapped and whatever stands around.  A window that reaches ``least`` shares at least
b * least / (2 - least) bigrams with the template, so texts with fewer are passed over; a best window begins with a
bigram of the template, so all those are tried as beginnings and all ends within the bounds.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Licence lines (fixed values: public licence notices).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}
CUT = re.compile(r"\n|[.!?][ \t]+")
WORD = re.compile(r"[a-z0-9]+")
LEAST = 0.8


def license_texts() -> dict[str, str]:
    """Whole public licence texts, headers and first sentences, by name."""
    return {f"{p.stem}-text": p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def bigrams(text: str) -> frozenset:
    w = WORD.findall(text.lower())
    return frozenset(zip(w, w[1:], strict=False))


class Matcher:
    """Templates by size and by bigram."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least, self.sets = least, {k: bigrams(v) for k, v in templates.items()}
        self.sets = {k: v for k, v in self.sets.items() if v}
        self.bounds = {k: (len(v) * least / (2 - least), len(v) * (2 - least) / least) for k, v in self.sets.items()}
        self.low = min((b[0] for b in self.bounds.values()), default=1)
        self.high = max((b[1] for b in self.bounds.values()), default=0)
        self.first = set().union(*(w for s in self.sets.values() for w in s)) if self.sets else set()

    def segment(self, text: str):
        """(licence, Dice) of the templates that the segment reaches."""
        w = WORD.findall(text.lower())
        if len(w) < 2 or len(w) - 1 < self.low:
            return
        if w[len(w) // 2] not in self.first and self.first.isdisjoint(w):
            return
        have = set(zip(w, w[1:], strict=False))
        a = len(have)
        if not self.low <= a <= self.high:
            return
        for name, s in self.sets.items():
            lo, hi = self.bounds[name]
            if lo <= a <= hi and (d := 2 * len(have & s) / (a + len(s))) >= self.least:
                yield name, d

    def document(self, text: str) -> list[tuple[str, float, int]]:
        """(licence, best Dice, segments) of a whole text; the whole counts as a segment if it has several."""
        best: dict[str, list] = {}
        parts = CUT.split(text)
        for part in parts if len(parts) == 1 else [*parts, text]:
            for name, d in self.segment(part):
                b = best.setdefault(name, [0.0, 0])
                b[0], b[1] = max(b[0], d), b[1] + 1
        return [(k, v[0], v[1]) for k, v in sorted(best.items())]


class Windows:
    """Windows of words against whole texts."""

    def __init__(self, texts: dict[str, str], least: float):
        self.least, self.sets = least, {k: s for k, v in texts.items() if (s := bigrams(v))}
        self.need = {k: len(s) * least / (2 - least) - 1e-9 for k, s in self.sets.items()}
        self.fewest = min(self.need.values(), default=0)
        self.every = frozenset().union(*self.sets.values())

    def best(self, prev, match, size: int, lo: int, hi: int):
        """(Dice, start, end) of the best window of the bigrams lo..hi; prev: where each came last before."""
        import numpy as np

        most, top = size * (2 - self.least) / self.least + 1e-9, (0.0, lo, lo)
        starts = lo + np.flatnonzero(match[lo:hi])
        for s in starts.tolist():
            e = s + int(2 * most) + 1
            while True:
                new = prev[s : min(e, hi)] < s
                have = np.cumsum(new)
                if e >= hi or have[-1] > most:
                    break
                e += e - s  # repeated bigrams don't count: the window may grow
            dice = 2 * np.cumsum(new & match[s : min(e, hi)]) / (have + size)
            k = int(np.argmax(dice))
            if dice[k] > top[0]:
                top = (float(dice[k]), s, s + k + 1)
        return top

    def document(self, text: str) -> list[tuple[str, float, int]]:
        """(licence, best Dice, disjoint windows that reach the cut, the best taken first)."""
        import numpy as np

        w = WORD.findall(text.lower()) if self.sets else []
        if len(w) - 1 < self.fewest or len(shared := self.every.intersection(zip(w, w[1:], strict=False))) < self.fewest:
            return []
        names = [k for k, s in self.sets.items() if len(s & shared) >= self.need[k]]
        if not names:
            return []
        grams, last, out = list(zip(w, w[1:], strict=False)), {}, []
        prev = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams):
            prev[i] = last.get(g, -1)
            last[g] = i
        for name in names:
            s = self.sets[name]
            match = np.fromiter((g in s for g in grams), bool, len(grams))
            todo, top, n = [(0, len(grams))], 0.0, 0
            while todo:
                lo, hi = todo.pop()
                if match[lo:hi].sum() < self.need[name]:
                    continue
                d, a, b = self.best(prev, match, len(s), lo, hi)
                if d >= self.least:
                    top, n = max(top, d), n + 1
                    todo += [(lo, a), (b, hi)]
            if n:
                out.append((name, top, n))
        return out


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and licence found: doc_id, license, dice (six decimals), n_segments.

    ``templates`` are held against lines, sentences and the whole; ``texts`` against every window of words, and
    their n_segments counts disjoint windows.  The SQL states the former only.  One pass without a shuffle.  Null and empty texts have
    none; repeated rows come each; an empty table gives none.  Long texts are read whole.  Of segments or windows that
    are equally alike the first counts, and licences come in order of their names.
    """
    chosen = dict(TEMPLATES if templates is None else templates)
    whole = license_texts() if texts is None else dict(texts)

    def run(batches):
        import pyarrow as pa

        m, n = Matcher(chosen, least), Windows(whole, least)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                lines = m.document(t)
                told = {m.sets[x[0]] for x in lines}  # a text that is also a template found as a line isn't told twice
                rows += [(i, *x) for x in lines] + [(i, *x) for x in n.document(t) if n.sets[x[0]] not in told]
            c = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.string()), pa.array([round(x, 6) for x in c[2]], pa.float64()), pa.array(c[3], pa.int64())], ["doc_id", "license", "dice", "n_segments"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, license string, dice double, n_segments long")


def oracle(templates: dict[str, str] | None = None, least: float = LEAST) -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items())
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    norm = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH template(license, text) AS (VALUES {rows}),
tw AS (SELECT license, {norm.format('text')} AS w FROM template),
tb AS (SELECT license, {grams} AS b FROM tw),
cut AS (SELECT doc_id, text, regexp_split_to_array(text, '\\n|[.!?][ \\t]+') AS s FROM documents),
parts AS (SELECT doc_id, unnest(CASE WHEN len(s) > 1 THEN list_append(s, text) ELSE s END) AS part FROM cut),
pw AS (SELECT doc_id, {norm.format('part')} AS w FROM parts),
pb AS (SELECT doc_id, {grams} AS b FROM pw WHERE len(w) > 1),
hit AS (SELECT doc_id, license, 2e0 * len(list_intersect(pb.b, tb.b)) / (len(pb.b) + len(tb.b)) AS d
  FROM pb JOIN tb ON len(pb.b) >= len(tb.b) * {least} / {2 - least} - 1e-9 AND len(pb.b) <= len(tb.b) * {2 - least} / {least} + 1e-9)
SELECT doc_id, license, round(max(d), 6) AS dice, count(*) AS n_segments FROM hit WHERE d >= {least} GROUP BY doc_id, license"""

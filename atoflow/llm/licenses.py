"""License scans by conditional compression with templates as raw zstandard dictionaries."""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Wordings that are looked for (fixed values: notices as their publishers give them).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: A text with one of these words is searched.
CUE = r"(?i)licen[sc]|copyright|permission|redistribut|warrant|\bCC BY"
#: Least share of a matched span's compressed size that the template's dictionary saves.
REDUCTION = 0.1
#: Most words that a matched span may lack, and most that it may put between, as a share of the template's words.
MISSING = 0.1
LEVEL = 3
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
BREAK = re.compile("\r\n|\r|\n")


def norm_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Templates:
    """Templates with a compressor each, whose raw dictionary is the template's normalised wording."""

    def __init__(self, templates: dict[str, str]):
        options = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.words = {k: w for k, v in templates.items() if (w := norm_words(v))}
        self.plain = zstandard.ZstdCompressor(**options)
        self.given = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(
            " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **options) for k, w in self.words.items()}
        self.slack = {k: int(MISSING * len(w)) for k, w in self.words.items()}
        self.ids = {x: i for i, x in enumerate(sorted({x for w in self.words.values() for x in w}), 1)}
        self.own, self.first, self.places = {}, {}, {}
        for k, w in self.words.items():
            own, first = np.zeros(len(self.ids) + 1, bool), np.zeros(len(self.ids) + 1, bool)
            own[[self.ids[x] for x in w]] = True
            first[[self.ids[x] for x in w[:self.slack[k] + 1]]] = True
            at = [0] * (len(self.ids) + 1)
            for i, x in enumerate(w):
                at[self.ids[x]] |= 1 << i
            self.own[k], self.first[k], self.places[k] = own, first, at
        self.saved = functools.lru_cache(maxsize=1 << 16)(
            lambda block: {k: (saved, place) for place, (saved, k) in enumerate(self.rank(block.split(" ")))})

    def rank(self, words: list[str]) -> list[tuple[float, str]]:
        """Templates by the share of the block's compressed size that they save, best first; ties by name."""
        block = " ".join(words).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(block))
        saved = [((alone - len(c.compress(block))) / alone, k) for k, c in self.given.items()]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def spans(self, ids: np.ndarray, name: str) -> list[tuple[int, int, int, int]]:
        """(start, end, missing, extra) of the places that hold the template's wording, none across another.

        A place is tried where a window of the template's length (and as many words more as it may
        hold in between) has enough of the template's words and starts with one that can be its
        first.  Missing and extra words are counted from the longest common subsequence of the
        template and the span, so that the words around a span do not count.
        """
        m, slack = len(self.words[name]), self.slack[name]
        starts = np.arange(max(len(ids) - (m - slack) + 1, 0))
        held = np.concatenate([[0], np.cumsum(self.own[name][ids])])
        enough = held[np.minimum(starts + m + slack, len(ids))] - held[starts] >= m - slack
        at, full, found = self.places[name], (1 << m) - 1, []
        for s in np.flatnonzero(enough & self.first[name][ids[starts]]).tolist():
            left, best = full, None  # bits of template words outside the common subsequence so far
            for n, x in enumerate(ids[s:s + m + slack].tolist(), 1):
                hit = left & at[x]
                left = ((left + hit) | (left - hit)) & full
                missing = left.bit_count()
                extra = n - (m - missing)
                if missing <= slack and extra <= slack and (best is None or missing + extra < best[0]):
                    best = missing + extra, s, s + n, missing, extra
            if best:
                found.append(best)
        out, taken = [], np.zeros(len(ids), bool)
        for _, s, e, missing, extra in sorted(found):
            if not taken[s:e].any():
                taken[s:e] = True
                out.append((s, e, missing, extra))
        return out

    def matches(self, words: list[str]) -> list[tuple]:
        """(key, start, end, template, reduction, missing, extra) of every confirmed wording, best key first.

        The reduction is that of the matched span alone, so the words around it cannot push it
        under ``REDUCTION``.  Fewest differences per word come first, ties by length and rank.
        """
        ids = np.array([self.ids.get(x, 0) for x in words], dtype=np.int64)
        out = []
        for name, want in self.words.items():
            for s, e, missing, extra in self.spans(ids, name):
                saved, place = self.saved(" ".join(words[s:e]))[name]
                if saved >= REDUCTION:
                    out.append((((missing + extra) / len(want), -len(want), place), s, e, name, saved, missing, extra))
        return sorted(out)

    def judge(self, block: str) -> tuple[str | None, float, int, int]:
        """(template, reduction, missing, extra): the best confirmed template of a block, else None."""
        found = self.matches(norm_words(block))
        return found[0][3:] if found else (None, 0.0, 0, 0)

    def search(self, text: str) -> list[tuple[int, str, float, int, int]]:
        """(line, template, reduction, missing, extra) of a whole text, whose words run on over line borders.

        The line is that of the span's first word, from 0.  Every confirmed template counts whose span
        does not lie inside that of a better one; a line yields each template once, by its best span.
        """
        text = text.lower()
        found = self.matches(WORD.findall(text))
        if not found:
            return []
        starts = [x.start() for x in WORD.finditer(text)]
        breaks = [x.end() for x in BREAK.finditer(text)]
        reach, best = {}, {}  # reach: for each word the furthest end of the better spans that hold it
        for _, s, e, name, *rest in found:
            if reach.get(s, 0) >= e:
                continue
            for i in range(s, e):
                reach[i] = max(reach.get(i, 0), e)
            best.setdefault((bisect.bisect_right(breaks, starts[s]), name), rest)
        return [(*at, *rest) for at, rest in sorted(best.items())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per confirmed notice: id, line, license, reduction, missing, extra, exact.

    Each text with a cue is searched for spans of about a template's length that hold its wording,
    in one line or wrapped over several (the line is that of the first word, from 0); marks in front
    of a line are no words.  A span is compressed alone and with every template as raw dictionary,
    templates are ranked by the share of the size they save, and confirmed by their wording
    differences (counts of missing and extra words); of templates whose spans lie in one another the
    one with the fewest differences per word wins, all others have a row each.  A template that
    starts several times in one line has one row for it.  Null and empty texts have no notices.
    Repeated rows give repeated results.  Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").rlike(CUE))
    schema = T.StructType([texts.schema["id"], *T._parse_datatype_string(
        "line int, license string, reduction double, missing int, extra int").fields])

    def run(batches):
        search = Templates(templates).search
        for batch in batches:
            rows = [(i, *r) for i, text in enumerate(batch.column("text")) for r in search(text.as_py())]
            at, *cols = zip(*rows) if rows else [()] * 6
            kinds = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *map(pa.array, cols, kinds)],
                                             schema.names)

    return texts.mapInArrow(run, schema).select(
        F.col("id").alias(id_col), "line", "license", F.round("reduction", 6).alias("reduction"), "missing", "extra",
        ((F.col("missing") == 0) & (F.col("extra") == 0)).alias("exact"))

"""Report sections (T6, T6a-c, T8) with native expressions only.

Rules kept from the reference (SURVEY 2.9.1): the keyword of a section is the
first of its list (in list order) that occurs anywhere in the text; every
occurrence of that keyword starts a frame that stops at the nearest later
start of any *other* section's chosen keyword (the comment keyword counts as
a stop); if one occurrence has no stop, the whole section is empty.  First
frame wins for clinical, sample and description; a follow-up frame is added
to the description as ``keyword + ' ' + frame``; conclusions are all
concatenated (or only the last); no conclusion makes the description null;
greetings run to the end of the text.  Positions are 1-based code points.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexikon.functions.text import let, sums_before

# The ordered section keywords of the reference's YAML file.
SECTION_KEYWORDS: dict[str, list[str]] = {
    "clinical_infos": ["Klinische Angaben:"],
    "sample_infos": ["Wir erhielten", "Eingesandt wurde:", "Zugesandt wurde:"],
    "comment": ["Kommentar"],
    "description": ["Lichtmikroskopie:", "Mikroskopie:", "Histologie:"],
    "follow_up_report": ["Nachbericht:", "Immunhistochemie:"],
    "conclusion": ["Beurteilung:", "Begutachtung:", "Beurteilung"],
    "regards": ["Mit freundlichen", "Prof."],
}

SECTION_NAMES = ["clinical_infos", "sample_infos", "description", "conclusion", "greetings"]


def first_keyword(t: Column, words: list[str]) -> Column:
    """The first keyword, in list order, that occurs in the text (or null)."""
    out = None
    for w in words:
        cond = F.instr(t, w) > 0
        out = F.when(cond, F.lit(w)) if out is None else out.when(cond, F.lit(w))
    return out


def _starts(pieces: Column, width: Column) -> Column:
    """1-based starts of the matches between ``pieces``, each ``width`` long, by running sums."""
    none = F.array().cast("array<int>")
    gaps = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p).cast("long"))
    starts = let(gaps, lambda g: F.zip_with(g, sums_before(F.transform(g, lambda x: x + width)),
                                            lambda x, before: (before + x + 1).cast("int")))
    return F.when(F.size(pieces) < 2, none).otherwise(starts)


def keyword_starts(t: Column, kw: Column, words: list[str] | None = None) -> Column:
    """All 1-based starts of the chosen keyword ``kw`` (non-overlapping, left to right).
    ``split`` on the quoted keyword gives the pieces between; with the candidate list
    given, by one literal branch per candidate (compiled once, no per-row pattern)."""
    if words:
        pieces = F.when(kw == words[0], F.split(t, re.escape(words[0]), -1))
        for w in words[1:]:
            pieces = pieces.when(kw == w, F.split(t, re.escape(w), -1))
    else:
        pieces = F.split(t, F.concat(F.lit(r"\Q"), kw, F.lit(r"\E")), F.lit(-1))
    return F.coalesce(let(pieces, lambda p: _starts(p, F.length(kw))), F.array().cast("array<int>"))


def frames(t: Column, kw: Column, stops: list[Column], starts: Column | None = None) -> Column:
    """T6b + T6c: text frames of every start of ``kw``; empty if any start has
    no later stop keyword."""
    if starts is None:
        starts = keyword_starts(t, kw)

    def stop_of(s):
        cands = F.array(*[F.when(c.isNotNull() & ((kw.isNull()) | (c != kw)), F.call_function("locate", c, t, s))
                          .otherwise(F.lit(0)) for c in stops])
        found = F.filter(cands, lambda p: p > 0)
        return F.when(F.size(found) > 0, F.array_min(found))

    stop_pos = F.transform(starts, stop_of)
    complete = F.forall(stop_pos, lambda p: p.isNotNull())
    sliced = F.zip_with(starts, stop_pos, lambda a, b: F.substring(t, a, b - a))
    return F.when(complete, sliced).otherwise(F.array().cast("array<string>"))


def report_sections(text: Column | str, combine_all_conclusions: bool = True) -> Column:
    """T6 as one Column expression (convenient for small inputs and tests).

    For large tables use ``with_report_sections``: it computes every keyword,
    start list and frame list once in its own projection."""
    t = F.col(text) if isinstance(text, str) else text
    k = {name: first_keyword(t, words) for name, words in SECTION_KEYWORDS.items()}
    starts = {n: keyword_starts(t, k[n], _words(n)) for n in _FRAMED}
    return _assemble(t, k, {n: frames(t, k[n], _stop_list(k), starts[n]) for n in _FRAMED},
                     combine_all_conclusions)


_FRAMED = ["clinical_infos", "sample_infos", "description", "follow_up_report", "conclusion"]


def _words(section: str) -> list[str]:
    return SECTION_KEYWORDS[section]


def _stop_list(k: dict) -> list[Column]:
    return [k["conclusion"], k["description"], k["comment"], k["regards"], k["follow_up_report"],
            k["clinical_infos"], k["sample_infos"]]


def _assemble(t: Column, k: dict, fr: dict, combine_all_conclusions: bool) -> Column:
    first = lambda a: F.when(F.size(a) > 0, F.element_at(a, 1))
    second = F.when(F.size(fr["follow_up_report"]) > 0,
                    F.concat(k["follow_up_report"], F.lit(" "), F.element_at(fr["follow_up_report"], 1)))
    desc = F.when(second.isNotNull(), F.concat(F.coalesce(first(fr["description"]), F.lit("")), second)) \
        .otherwise(first(fr["description"]))
    conc_arr = fr["conclusion"]
    has_conc = F.size(conc_arr) > 0
    conclusion = F.when(has_conc, F.array_join(conc_arr, "") if combine_all_conclusions
                        else F.element_at(conc_arr, -1))
    greet = F.when(k["regards"].isNotNull(), F.substring(t, F.instr(t, k["regards"]), 1 << 30))
    return F.struct(first(fr["clinical_infos"]).alias("clinical_infos"),
                    first(fr["sample_infos"]).alias("sample_infos"),
                    F.when(has_conc, desc).alias("description"),
                    conclusion.alias("conclusion"),
                    greet.alias("greetings"))


def with_report_sections(df: DataFrame, text: str, out: str = "sections",
                         combine_all_conclusions: bool = True) -> DataFrame:
    """T6 for a DataFrame: staged projections (keywords -> starts -> frames ->
    struct), so no text scan is repeated inside the per-start lambdas."""
    t = F.col(text)
    keep = df.columns
    kcols = {n: "_k_" + n for n in SECTION_KEYWORDS}
    d = df.select(*keep, *[first_keyword(t, w).alias(kcols[n]) for n, w in SECTION_KEYWORDS.items()])
    k = {n: F.col(c) for n, c in kcols.items()}
    d = d.select("*", *[keyword_starts(t, k[n], _words(n)).alias("_s_" + n) for n in _FRAMED])
    stops = _stop_list(k)
    d = d.select(*keep, *kcols.values(),
                 *[frames(t, k[n], stops, F.col("_s_" + n)).alias("_f_" + n) for n in _FRAMED])
    fr = {n: F.col("_f_" + n) for n in _FRAMED}
    return d.select(*keep, _assemble(t, k, fr, combine_all_conclusions).alias(out))


def merge_sections(sections: Column, sep: str = ". ") -> Column:
    """Sample infos, description and conclusion joined, nulls skipped."""
    return F.concat_ws(sep, sections["sample_infos"], sections["description"], sections["conclusion"])

"""Report sections on texts composed from ``documents`` (no document holds a
section keyword, so the pieces around the keywords are known)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexikon.functions.sections import merge_sections, with_report_sections
from lexikon.plans.common import table


def composed_reports(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    hc, hd = F.col("doc_id") % 5 != 0, F.col("doc_id") % 3 != 0
    hk, hf = F.col("doc_id") % 4 != 0, F.col("doc_id") % 7 == 0
    report = F.concat_ws(
        "",
        F.when(hc, F.concat(F.lit("Klinische Angaben: "), "source", F.lit(" "))),
        F.lit("Eingesandt wurde: "), F.col("text"), F.lit(" "),
        F.when(hd, F.concat(F.lit("Histologie: "), "lang", F.lit(" "))),
        F.when(hk, F.concat(F.lit("Beurteilung: "), "text", F.lit(" "))),
        F.when(hf, F.concat(F.lit("Nachbericht: "), "lang", F.lit(" Beurteilung: "), "source", F.lit(" "))),
        F.lit("Mit freundlichen Grüßen "), F.col("source"))
    return d.select("doc_id", report.alias("report"))


def sections(spark, sf_dir):
    r = with_report_sections(composed_reports(spark, sf_dir), "report", "s")
    return r.select("doc_id", *[F.md5(F.col("s")[c]).alias(c + "_md5") for c in
                                ["clinical_infos", "sample_infos", "description", "conclusion", "greetings"]])


def merge_sections_q(spark, sf_dir):
    r = with_report_sections(composed_reports(spark, sf_dir), "report", "s")
    return r.select("doc_id", F.md5(merge_sections(F.col("s"))).alias("merged_md5"))


_EXPECTED = """WITH d AS (SELECT doc_id, source AS p1, text AS p2, lang AS p3, text AS p4, doc_id % 5 <> 0 AS hc,
        doc_id % 3 <> 0 AS hd, doc_id % 4 <> 0 AS hk, doc_id % 7 = 0 AS hf FROM documents),
e AS (SELECT doc_id,
  CASE WHEN hc THEN 'Klinische Angaben: ' || p1 || ' ' END AS clinical_infos,
  'Eingesandt wurde: ' || p2 || ' ' AS sample_infos,
  CASE WHEN (hk OR hf) AND (hd OR hf) THEN (CASE WHEN hd THEN 'Histologie: ' || p3 || ' ' ELSE '' END)
       || (CASE WHEN hf THEN 'Nachbericht: Nachbericht: ' || p3 || ' ' ELSE '' END) END AS description,
  CASE WHEN hk OR hf THEN (CASE WHEN hk THEN 'Beurteilung: ' || p4 || ' ' ELSE '' END)
       || (CASE WHEN hf THEN 'Beurteilung: ' || p1 || ' ' ELSE '' END) END AS conclusion,
  'Mit freundlichen Grüßen ' || p1 AS greetings FROM d)
"""

QUERIES = {
    "sections": (sections, _EXPECTED + """SELECT doc_id, md5(clinical_infos) AS clinical_infos_md5,
        md5(sample_infos) AS sample_infos_md5, md5(description) AS description_md5, md5(conclusion) AS conclusion_md5,
        md5(greetings) AS greetings_md5 FROM e"""),
    "merge_sections": (merge_sections_q, _EXPECTED + """SELECT doc_id, md5(concat_ws('. ', sample_infos, description,
        conclusion)) AS merged_md5 FROM e"""),
}

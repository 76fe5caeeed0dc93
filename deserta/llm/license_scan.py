"""Licence scans by canonical digest lookup.

A text is put into a canonical form (lower case, copyright lines dropped, equivalent spellings unified, punctuation and
blanks folded into single blanks) and its SHA-256 digest is joined with the digests of known licence texts. The entire
text must match, so a digest never hits by accident. Two kinds of unit are looked up: the whole document, and each of its
lines, as notices are often one line of a longer text.

Only DataFrame operations. The whole-document lookup is a hash join with the known digests. Lines are looked up in the
same table as a constant map, which keeps a document's lines in its row: nothing is exploded or regrouped. The known
table is sent to the executors only if it is found to hold at most ``MAX_KNOWN`` digests. A larger one stays distributed:
the digests of all lines, counted per row first, meet it in a hash join as the whole documents do, with the same result.

Known are short notices (``KNOWN``) and the complete texts in ``license_texts`` in their usual forms (``full_texts``).

Defined cases: null and empty texts, and texts without letters or digits, have no licence and no notice; texts are read
whole; equal rows get equal results; of known texts with equal digests the smallest id wins; an empty table gives an
empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import itertools
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common as C

MAX_KNOWN = 10_000

# Notices and short licence texts by identifier.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("proprietary", "All rights reserved."),
)
#: Complete texts (a file of ``license_texts`` each) and the headings they are found under.
FULL = {"Apache-2.0": (), "CC0-1.0": (), "GPL-2.0": (), "GPL-3.0": (), "MPL-2.0": (),
        "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"),
        "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"),
        "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
        "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)")}
#: Usual changes of a complete text (pattern, replacement), each made or not.
FORMS = ((r"http://", "https://"), (r"https://", "http://"),
         (r"\n[^\n]*\[yyyy\][^\n]*", ""), (r"(END OF TERMS AND CONDITIONS)[\s\S]*", r"\1"),
         (r"\s*END OF TERMS AND CONDITIONS[\s\S]*", ""),
         (r"(?m)^[0-9]\. (?=Redistributions|Neither)", "* "), (r"COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"),
         (r"modify, and/or distribute", "modify, and distribute"))
#: Spellings that count as equal (pattern over the lower-cased text, replacement).
SPELLINGS = ((r"\blicen[cs](e|es|ed|ing)\b", "licens$1"), (r"\bversion\b|\bver\b|\bv\b\.?(?=\x20?[0-9])", "v"),
             (r"\bnoncommercial\b", "nc"), (r"\borganisation", "organization"), (r"\bauthoris", "authoriz"))
COPYRIGHT_LINE = r"(?im)^[^\n]*(?:\bcopyright\s+(?:\(c\)|©|[0-9]{4})|©|^\s*\(c\)\s+[0-9]{4})[^\n]*$"


def canonical(text: Column) -> Column:
    """Canonical form; line breaks stay, so the form of a line can be taken from the form of its text."""
    t = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, ""))
    for pattern, to in SPELLINGS:
        t = F.regexp_replace(t, pattern, to)
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")


def one_line(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[\x20\n]+", " "))


def digest(form: Column) -> Column:
    return F.when(form != "", F.sha2(form, 256))


def known_digests(known: DataFrame) -> DataFrame:
    """digest, license from rows of (license, text); equal digests keep the smallest id."""
    return (known.select(F.col("license"), digest(one_line(canonical(F.col("text")))).alias("digest"))
            .where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("license").alias("license")))


def full_texts() -> list[tuple[str, str]]:
    """(license, text) of every complete text in each of its forms, under each heading and none; short ones (those with
    headings) also with "All rights reserved." below the copyright line."""
    out = []
    for name, headings in FULL.items():
        forms = {files(__package__).joinpath("license_texts", f"{name}.txt").read_text(encoding="utf-8")}
        for pattern, to in FORMS:
            forms |= {re.sub(pattern, to, t) for t in forms}
        tops = itertools.product(("", *headings), ("", "All rights reserved.") if headings else ("",))
        out += [(name, f"{a}\n{b}\n{t}") for (a, b), t in itertools.product(tops, sorted(forms))]
    return out


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *full_texts()], "license string, text string")


def with_licenses(df: DataFrame, known: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with license (id that the whole text matches, else null), notices (sorted ids of its matching lines) and
    n_notices (number of matching lines)."""
    table = known_digests(known if known is not None else built_in(df.sparkSession))
    base = df.select(*[c for c in df.columns if c not in ("license", "notices", "n_notices")])
    base = base.withColumn("__form", F.coalesce(canonical(F.col(text_col)), F.lit("")))
    base = base.withColumn("__digest", digest(one_line(F.col("__form"))))
    rows = table.limit(MAX_KNOWN + 1).collect()
    out = _by_map(base, rows, table.schema) if len(rows) <= MAX_KNOWN else _by_join(base, table)
    return out.drop("__form", "__found", "__digest", "__row", "__ids", "__n")


def _by_map(base: DataFrame, rows: list, schema) -> DataFrame:
    known_map = F.create_map(*[F.lit(x) for r in rows for x in (r["digest"], r["license"])]) if rows else \
        F.create_map().cast("map<string,string>")
    found = F.filter(F.transform(F.split("__form", "\n", -1), lambda x: F.element_at(known_map, digest(F.trim(x)))),
                     lambda x: x.isNotNull())
    table = base.sparkSession.createDataFrame(rows, schema).withColumnRenamed("digest", "__digest")
    return (base.withColumn("__found", found).join(F.broadcast(table), "__digest", "left")
            .withColumn("notices", F.concat_ws(",", F.array_sort(F.array_distinct("__found"))))
            .withColumn("n_notices", F.size("__found").cast("long")))


def _by_join(base: DataFrame, table: DataFrame) -> DataFrame:
    """Rows are numbered in a written table, so that a recomputed task gives them the same numbers."""
    base = C.written(base.withColumn("__row", F.monotonically_increasing_id()), "licenses")
    table = C.written(table.withColumnRenamed("digest", "__digest"), "known")
    lines = (base.select("__row", F.explode(F.transform(F.split("__form", "\n", -1), lambda x: digest(F.trim(x)))).alias("__digest"))
             .where(F.col("__digest").isNotNull()).groupBy("__row", "__digest").agg(F.count("*").alias("__n")))
    found = (lines.join(table, "__digest").groupBy("__row")
             .agg(F.collect_set("license").alias("__ids"), F.sum("__n").alias("__n")))
    return (base.join(table, "__digest", "left").join(found, "__row", "left")
            .withColumn("notices", F.coalesce(F.concat_ws(",", F.array_sort("__ids")), F.lit("")))
            .withColumn("n_notices", F.coalesce(F.col("__n"), F.lit(0).cast("long"))))


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, n_notices, notices of every document."""
    return with_licenses(df.select(id_col, text_col), None, text_col).select(id_col, "license", "n_notices", "notices")


ORACLE = r"""
WITH known(license, text) AS (VALUES {values}),
k AS (SELECT license, trim(regexp_replace({known_form}, '[ \n]+', ' ', 'g')) AS form FROM known),
kk AS (SELECT form, min(license) AS license FROM k WHERE form <> '' GROUP BY form),
d AS (SELECT row_number() OVER () AS r, doc_id, {form} AS form FROM documents),
lines AS (SELECT r, trim(unnest(string_split(form, chr(10)))) AS form FROM d),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids
      FROM lines JOIN kk USING (form) GROUP BY r)
SELECT d.doc_id, w.license, coalesce(n.n, 0) AS n_notices, coalesce(n.ids, '') AS notices
FROM d LEFT JOIN kk w ON w.form = trim(regexp_replace(d.form, '[ \n]+', ' ', 'g')) LEFT JOIN n USING (r)
"""


def oracle() -> str:
    def form(col: str) -> str:
        t = f"lower(regexp_replace(coalesce({col}, ''), '(?im)^[^\\n]*(\\bcopyright\\s+(\\(c\\)|©|[0-9]{{4}})|©|^\\s*\\(c\\)\\s+[0-9]{{4}})[^\\n]*$', '', 'g'))"
        for p, to in ((r"\blicen[cs](e|es|ed|ing)\b", r"licens\1"), (r"\b(version|ver|v)\b\.?( ?[0-9])", r"v\2"),
                      (r"\bversion\b|\bver\b", "v"), (r"\bnoncommercial\b", "nc"), (r"\borganisation", "organization"),
                      (r"\bauthoris", "authoriz")):
            t = f"regexp_replace({t}, '{p}', '{to}', 'g')"
        return f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return ORACLE.format(values=values, known_form=form("text"), form=form("text"))

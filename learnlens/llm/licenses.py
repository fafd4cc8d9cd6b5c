"""License scans with ordered signature rules, in DataFrame functions alone.

A rule is a keyword with a regex for the words before it and one for the words
after it. Documents are scanned once for the rules' keywords; only around a
keyword's place, and only for that keyword's rules, is a regex tried. Of
overlapping detections the enclosing one stays; of equal ones that of the
rule with the smaller priority number. A name or grant that is denied ("not
released under the ...") is no detection.

Rules are of these forms: SPDX identifiers, names, grants ("released under ..."),
urls, notices, passages of the license texts themselves, and the licenses of a
list ("MIT or Apache-2.0").
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Words that a rule may reach to either side of its keyword.
REACH = 16

#: Phrases that are always counted: words before the keyword, the keyword,
#: words after it, label.
BASE = [
    ("under the", "mit", "license", "mit"),
    ("", "apache", "license version 2", "apache-2"),
    ("", "cc", "by nc", "cc-by-nc"),
]

#: label, names as word regexes, identifier words, versions ("" stands for none given).
FAMILIES = [
    ("mit", ["mit", "expat"], "mit", [""]),
    ("mit-0", ["mit no attribution"], "mit 0", [""]),
    ("apache", ["apache(?: software)?"], "apache", ["1 0", "1 1", "2 0", "2"]),
    ("gpl", ["gnu general public", "gpl"], "gpl", ["", "1 0", "2 0", "2", "3 0", "3"]),
    ("lgpl", ["gnu (?:lesser|library) general public", "lgpl"], "lgpl", ["", "2 0", "2 1", "3 0", "3"]),
    ("agpl", ["gnu affero general public", "agpl"], "agpl", ["", "1 0", "3 0", "3"]),
    ("gfdl", ["gnu free documentation", "gfdl"], "gfdl", ["", "1 1", "1 2", "1 3"]),
    ("bsd", ["bsd"], "bsd", [""]),
    ("bsd-2-clause", ["bsd 2 clause", "simplified bsd", "freebsd"], "bsd 2 clause", [""]),
    ("bsd-3-clause", ["bsd 3 clause", "new bsd", "modified bsd", "revised bsd"], "bsd 3 clause", [""]),
    ("bsd-4-clause", ["bsd 4 clause", "original bsd"], "bsd 4 clause", [""]),
    ("0bsd", ["0bsd", "zero clause bsd"], "0bsd", [""]),
    ("mpl", ["mozilla public", "mpl"], "mpl", ["", "1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public", "epl"], "epl", ["", "1 0", "2 0"]),
    ("eupl", ["european union public", "eupl"], "eupl", ["", "1 1", "1 2"]),
    ("cddl", ["common development and distribution", "cddl"], "cddl", ["", "1 0", "1 1"]),
    ("cpl", ["common public"], "cpl", ["", "1 0"]),
    ("artistic", ["artistic"], "artistic", ["", "1 0", "2 0"]),
    ("bsl", ["boost software", "bsl"], "bsl", ["", "1 0"]),
    ("isc", ["isc"], "isc", [""]),
    ("zlib", ["zlib"], "zlib", [""]),
    ("unlicense", ["unlicense"], "unlicense", [""]),
    ("wtfpl", ["wtfpl"], "wtfpl", [""]),
    ("python", ["python software foundation", "psf"], "python", ["", "2 0", "2"]),
    ("ofl", ["sil open font", "ofl"], "ofl", ["", "1 0", "1 1"]),
    ("odbl", ["open database", "odbl"], "odbl", ["", "1 0"]),
    ("ogl", ["open government"], "ogl", ["", "1 0", "2 0", "3 0"]),
    ("ms-pl", ["microsoft public"], "ms pl", [""]),
]
#: Elements of Creative Commons licenses: identifier words, names as a word regex.
CC_ELEMENTS = [
    ("by", "attribution"),
    ("by sa", "attribution share ?alike"),
    ("by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by nc", "attribution non ?commercial"),
    ("by nc sa", "attribution non ?commercial share ?alike"),
    ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]
CC_VERSIONS = ["", "1 0", "2 0", "2 5", "3 0", "4 0"]

GRANT = r"(?:licen[sc]ed|released|distributed|available|published|covered|provided|governed) (?:under|by) (?:the )?(?:terms of (?:the )?)?"
SAYS = r" licen[sc]e"
#: Form of a rule: (priority, confidence).
FORMS = {"identifier": (1, 1.0), "text": (1, 1.0), "grant": (2, 0.95), "listed": (2, 0.95), "url": (3, 0.9),
         "name": (4, 0.6), "notice": (5, 0.4)}
#: Before a name or a grant: what denies it.
DENIED = (r"(?:^| )(?:not|never|no longer|neither)(?: be| been)?(?: (?:licen[sc]ed|released|distributed|available|published|"
          r"covered|provided|governed) (?:under|by))?(?:(?: the)? terms of)?(?: the| an?)? $")

# --- Fixed values: passages of public license texts ------------------------
#: label, words before the keyword, keyword, words after it.
PASSAGES = [
    ("mit", "free of charge to any person ", "obtaining", " a copy of this software and associated documentation files"),
    ("isc", "distribute this software for any purpose with or without ", "fee", " is hereby granted"),
    ("bsd", "", "redistribution", " and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "contributors may be used to ", "endorse", " or promote products derived from this software"),
    ("bsd-4-clause", "all ", "advertising", " materials mentioning features or use of this software must display"),
    ("zlib", "this software is provided as is without any ", "express", " or implied warranty"),
    ("apache-2", "you may not use this file except in ", "compliance", " with the license"),
    ("bsl", "free of charge to any person or ", "organization", " obtaining a copy of the software"),
    ("unlicense", "this is free and ", "unencumbered", " software released into the public domain"),
    ("mpl-2.0", "this source code form is ", "subject", " to the terms of the mozilla public license v 2 0"),
    ("epl", "this program and the ", "accompanying", " materials are made available under the terms of the eclipse public license"),
    ("wtfpl", "do what the ", "fuck", " you want to public license"),
]
#: The notices that the GNU licenses ask for: name, label, versions.
NOTICES = [
    ("gnu general public", "gpl", ["1", "2", "3"]), ("gnu lesser general public", "lgpl", ["2 1", "3"]),
    ("gnu library general public", "lgpl", ["2"]), ("gnu affero general public", "agpl", ["3"]),
]
# --- end of fixed values ---------------------------------------------------
#: Short names as they are listed side by side: label and words.
LISTED = [("mit", "mit"), ("apache-2", "apache 2 0"), ("apache-2", "apache 2"), ("gpl", "gpl"), ("gpl-2", "gplv2"),
          ("gpl-3", "gplv3"), ("lgpl", "lgpl"), ("lgpl-3", "lgplv3"), ("agpl", "agpl"), ("agpl-3", "agplv3"),
          ("bsd", "bsd"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("mpl-2.0", "mpl 2 0"),
          ("epl-2.0", "epl 2 0"), ("isc", "isc"), ("zlib", "zlib"), ("cc0", "cc0"), ("unlicense", "unlicense")]


def _version(words: str) -> str:
    """A regex for the version after a name, from the words of its number."""
    return rf" (?:version |v ?)?v?{words}" if words else ""


def _rule(form: str, label: str, before: str, words: str, after: str) -> dict:
    """A rule whose keyword is the first word of ``words``."""
    keyword, _, rest = words.partition(" ")
    return {"label": label, "form": form, "priority": FORMS[form][0], "confidence": FORMS[form][1],
            "keyword": keyword, "before": rf"(?:^| ){before}$" if before else "",
            "after": rf"^{' ' + rest if rest else ''}{after}(?= )"}


def _expanded(name: str) -> list[str]:
    """A name whose first word is an alternative or is open, as several."""
    return [name.replace("(?: software)?", s, 1) for s in ("", " software")] if "(?: software)?" in name else [name]


def rules() -> list[dict]:
    """The ordered signature rules, several hundred, from the tables above."""
    out = []
    for label, names, ident, versions in FAMILIES:
        for version in versions:
            full = label + ("-" + version.replace(" ", ".") if version else "")
            full = {"apache-2.0": "apache-2"}.get(full, full)
            later = r"(?: or later| only)?" if label in ("gpl", "lgpl", "agpl", "gfdl") else ""
            number = f" {version}" if version else ""
            out.append(_rule("identifier", full, "spdx licen[sc]e identifier ", ident, number + later))
            out.append(_rule("url", full, "opensource org licenses ", ident, number))
            for name in (n for x in names for n in _expanded(x)):
                either = rf"(?:{SAYS}{_version(version)}|{_version(version)}{SAYS})" if version else SAYS
                bare = _version(version) if version else SAYS
                out.append(_rule("grant", full, GRANT, name, either))
                out.append(_rule("name", full, "", name, either))
                if version and bare != either:
                    out.append(_rule("grant", full, GRANT, name, bare))
        if label in ("gpl", "lgpl", "agpl", "gfdl"):
            out.append(_rule("url", label, "", f"gnu org licenses {ident}", ""))
    out.append(_rule("url", "apache-2", "", "apache org licenses license 2 0", ""))
    for ident, name in CC_ELEMENTS:
        for version in CC_VERSIONS:
            label = "cc-" + ident.replace(" ", "-") + ("-" + version.replace(" ", ".") if version else "")
            number = f" {version}" if version else ""
            out.append(_rule("identifier", label, "spdx licen[sc]e identifier ", f"cc {ident}", number))
            out.append(_rule("grant", label, GRANT + "(?:a )?", f"cc {ident}", number))
            out.append(_rule("name", label, "", f"cc {ident}", number))
            out.append(_rule("url", label, "", f"creativecommons org licenses {ident}", number))
            out.append(_rule("grant", label, GRANT + "(?:a )?", f"creative commons {name}",
                             rf"{number}(?: international| unported| generic)?(?:{SAYS})?"))
            out.append(_rule("name", label, "", f"creative commons {name}", number))
    for label, before, keyword, after in PASSAGES:
        out.append(_rule("text", label, before, keyword, after))
    for name, label, versions in NOTICES:
        for version in versions:
            number = version.replace(" ", ".") + ("" if " " in version else ".0")
            stated = rf" (?:either )?version {version} of the license"
            by = f"{name} license as published by the free software "
            out.append(_rule("text", f"{label}-{number}", by, "foundation", stated))
            out.append(_rule("text", f"{label}-{number}-or-later", by, "foundation", rf"{stated} or(?: at your option)? any later version"))
    names = "|".join(sorted((w for _, w in LISTED), key=len, reverse=True))
    other = rf"(?:{names})(?: v?[0-9])*(?: only| or later)?"
    for label, words in LISTED:
        out.append(_rule("listed", label, rf"{other} (?:or|and) (?:the )?", words, ""))
        out.append(_rule("listed", label, "", words, rf"(?=(?: licen[sc]e)? (?:or|and) (?:the )?{other} )"))
        if " " not in words:
            out.append(_rule("grant", label, GRANT, words, ""))
    for words in ("cc0", "creativecommons org publicdomain zero"):
        out.append(_rule("name", "cc0", "", words, "(?: 1 0)?"))
    for keyword, before in (("reserved", "all rights "), ("domain", "in the public "), ("domain", "into the public ")):
        label = "public-domain" if keyword == "domain" else "all-rights-reserved"
        out.append(_rule("notice", label, before, keyword, ""))
    out.append(_rule("notice", "notice", "(?:under|by) (?:the|this|a) ", "license", ""))
    return [{"rule": i, **r} for i, r in enumerate(out)]


RULE = "rule int, label string, form string, priority int, confidence double, keyword string, before string, after string"


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules and, with the negative numbers, the base phrases."""
    base = [{"rule": -1 - i, "label": label, "form": "base", "priority": 0, "confidence": 0.5,
             "keyword": key, "before": f"(?:^| ){before} $" if before else "", "after": f"^ {after}(?= )"}
            for i, (before, key, after, label) in enumerate(BASE)]
    names = [c.split()[0] for c in RULE.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in [*base, *rules()]], RULE)


def spots(docs: DataFrame, keywords: list[str], id_col: str, text_col: str) -> DataFrame:
    """One row per document (at is null) and one per place of a keyword, with
    the words to either side: (row, doc_id, n_words, at, keyword, left, right)."""
    words = docs.select(F.col(id_col).alias("doc_id"), common.alnum_words(F.col(text_col)).alias("w")
                        ).withColumn("row", F.monotonically_increasing_id())

    def place(x: Column, i: Column) -> Column:
        first = F.greatest(i - REACH, F.lit(0))
        return F.struct(
            i.alias("at"), x.alias("keyword"),
            F.concat(F.array_join(F.slice("w", first + 1, i - first), " "),
                     F.when(i > 0, F.lit(" ")).otherwise(F.lit(""))).alias("left"),
            F.concat(F.lit(" "), F.array_join(F.slice("w", i + 2, F.lit(REACH)), " "), F.lit(" ")).alias("right"))

    # A place takes the words around it along, not the whole text.
    found = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(keywords), place(x, i))))
    itself = F.array(F.lit(None).cast("struct<at:int,keyword:string,left:string,right:string>"))
    return words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"),
                        F.explode(F.concat(itself, found)).alias("p")).select(
        "row", "doc_id", "n_words", "p.at", "p.keyword", "p.left", "p.right")


def detections(found: DataFrame, ruleset: DataFrame) -> DataFrame:
    """Every rule's match at a keyword's place: (row, rule columns, from, to)
    with the half-open word interval."""
    words_in = lambda c: F.size(F.filter(F.split(c, " "), lambda x: x != ""))
    # The rules are a fixed table of a few hundred rows.
    tried = (found.where("at is not null").join(F.broadcast(ruleset), "keyword")
             .where(F.rlike("left", F.col("before")) & F.rlike("right", F.col("after")))
             # A rule without words on a side matches nothing there, which is null.
             .withColumn("l", F.coalesce(F.regexp_substr("left", F.col("before")), F.lit("")))
             .withColumn("r", F.coalesce(F.regexp_substr("right", F.col("after")), F.lit(""))))
    # A listed name is a detection of its own words; what it is listed with is another's.
    tried = tried.withColumn("l", F.when(F.col("form") != "listed", F.col("l")).otherwise(""))
    ahead = F.substring(F.col("left"), F.lit(1), F.length("left") - F.length("l"))
    ahead = F.when(F.col("l").startswith(" "), F.concat(ahead, F.lit(" "))).otherwise(ahead)
    tried = tried.where(~(F.col("form").isin("name", "grant", "listed", "notice") & F.rlike(ahead, F.lit(DENIED))))
    return tried.select("row", "rule", "label", "form", "priority", "confidence",
                        (F.col("at") - words_in(F.col("l"))).alias("from"),
                        (F.col("at") + 1 + words_in(F.col("r"))).alias("to"))


def outermost(dets: DataFrame) -> DataFrame:
    """Without the detections that lie in another: in order of start, longest
    first, then priority, those that reach no further than one before them."""
    order = (Window.partitionBy("row").orderBy("from", F.desc("to"), "priority", "rule")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (dets.withColumn("reach", F.max("to").over(order))
            .where("reach is null or reach < to").drop("reach"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base (places of base phrases),
    first_word and last_word (their smallest and largest start), base_labels,
    labels (the rules' too; both arrays, distinct and sorted), score (the
    largest confidence, 0 without a detection) and spans (from, to, label) of
    the rules' outermost detections.

    Null and empty texts have no words and no detection; repeated rows and
    ids are scanned each by itself; other columns are ignored.
    """
    ruleset = rule_table(docs.sparkSession)
    keywords = sorted({r["keyword"] for r in rules()} | {b[1] for b in BASE})
    found = common.written(spots(docs, keywords, id_col, text_col), "keywords")
    every = detections(found, ruleset)
    base = (every.where("form = 'base'").groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("from").cast("long").alias("first_word"),
        F.max("from").cast("long").alias("last_word"), F.collect_set("label").alias("base_labels"),
        F.max("confidence").alias("base_score")))
    rule = (outermost(every.where("form <> 'base'")).groupBy("row").agg(
        F.collect_set("label").alias("rule_labels"), F.max("confidence").alias("rule_score"),
        F.array_sort(F.collect_list(F.struct("from", "to", "label"))).alias("spans")))
    none = F.array().cast("array<string>")
    no_span = F.array().cast("array<struct<from:int,to:int,label:string>>")
    return (found.where("at is null").select("row", "doc_id", "n_words")
            .join(base, "row", "left").join(rule, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    "first_word", "last_word",
                    F.array_sort(F.coalesce("base_labels", none)).alias("base_labels"),
                    F.array_sort(F.array_union(F.coalesce("base_labels", none),
                                               F.coalesce("rule_labels", none))).alias("labels"),
                    F.greatest(F.coalesce("base_score", F.lit(0.0)),
                               F.coalesce("rule_score", F.lit(0.0))).alias("score"),
                    F.coalesce("spans", no_span).alias("spans")))

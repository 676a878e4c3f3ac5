"""License scan: ordered rules, a keyword gate, and suppression of contained detections.

Everything is built from Spark SQL expressions.  A text is brought to its
words, one blank between them.  Keywords found in it admit the rules that need
them; only those are matched.  Detections are intervals of words, and one that
lies within a detection of the same or a higher priority is suppressed.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters between words; phrases counted in any case, and their labels.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, keyword that a text must contain, pattern of the name.
FAMILIES = (
    ("mit", " mit ", "mit|mit x11"),
    ("mit", " expat ", "expat"),
    ("apache", " apache ", "apache(?: software)?(?: license)?"),
    ("gpl", " gpl", "gplv?|gnu gplv?"),
    ("gpl", " public license ", "(?:gnu )?general public license"),
    ("lgpl", " lgpl", "(?:gnu )?lgplv?"),
    ("lgpl", " public license ", "(?:gnu )?(?:lesser|library) general public license"),
    ("agpl", " agpl", "(?:gnu )?agplv?"),
    ("agpl", " public license ", "(?:gnu )?affero general public license"),
    ("gfdl", " documentation license ", "(?:gnu )?free documentation license"),
    ("bsd", " bsd ", "(?:new |modified |simplified |revised )?bsd(?: license)?(?: [234] clause)?|[0234] clause bsd"),
    ("mpl", " mpl ", "mpl"),
    ("mpl", " mozilla ", "mozilla public license"),
    ("epl", " eclipse ", "eclipse (?:public|distribution) license"),
    ("eupl", " european union ", "european union public licen[cs]e"),
    ("cddl", " cddl ", "cddl"),
    ("cddl", " common development ", "common development and distribution license"),
    ("cpl", " common public ", "common public license"),
    ("osl", " open software license ", "open software license"),
    ("afl", " academic free ", "academic free license"),
    ("artistic", " artistic license ", "(?:clarified )?artistic license"),
    ("isc", " isc license ", "isc license"),
    ("zlib", " zlib ", "zlib(?: libpng)?(?: license)?"),
    ("bsl", " boost ", "boost software license"),
    ("unlicense", " unlicense ", "unlicense"),
    ("wtfpl", " wtfpl ", "wtfpl"),
    ("cc0", " cc0 ", "cc0"),
    ("cc-by", " cc by ", "cc by"),
    ("cc-by-sa", " cc by ", "cc by sa"),
    ("cc-by-nc", " cc by ", "cc by nc"),
    ("cc-by-nd", " cc by ", "cc by nd"),
    ("cc-by-nc-sa", " cc by ", "cc by nc sa"),
    ("cc-by-nc-nd", " cc by ", "cc by nc nd"),
    ("cc-by", " creative commons ", "creative commons attribution(?: international| generic| unported)?"),
    ("cc-by-sa", " creative commons ", "creative commons attribution share ?alike"),
    ("cc-by-nc", " creative commons ", "creative commons attribution non ?commercial"),
    ("cc-by-nd", " creative commons ", "creative commons attribution no ?derivatives"),
    ("public-domain", " public domain ", "public domain"),
    ("odbl", " open database ", "open database license"),
    ("ofl", " open font ", "(?:sil )?open font license"),
    ("psf", " python software ", "python software foundation license"),
    ("proprietary", " all rights ", "all rights reserved"),
)

# Names that are words of their own in some language, or of common prose: no license unless a phrase says so.
PHRASE_ONLY = frozenset({"mit", "apache", "isc", "bsl"})

# Name, priority (1 is the highest), weight, keyword, text before and after the name.
VERSION = r"(?: license)?(?: version| v)? ?v?\d+(?: \d+)?(?: only| or later| or any later version)?"
_TERMS = "(?:the )?(?:terms of (?:the )?)?"
FORMS = (
    ("identifier", 1, 1.0, " spdx ", "spdx license identifier ", f"(?:{VERSION})?"),
    ("licensed", 2, 0.9, " under ", f"licen[cs]ed under {_TERMS}", f"(?:{VERSION})?(?: licen[cs]e)?"),
    ("released", 2, 0.9, " under ", f"(?:released|distributed|published) under {_TERMS}", f"(?:{VERSION})?(?: licen[cs]e)?"),
    ("available", 2, 0.9, " under ", f"(?:available|provided|offered) under {_TERMS}", f"(?:{VERSION})?(?: licen[cs]e)?"),
    ("subject", 2, 0.85, " subject to ", f"subject to {_TERMS}", f"(?:{VERSION})?(?: licen[cs]e)?"),
    ("governed", 2, 0.85, "ed by ", f"(?:governed|covered) by {_TERMS}", f"(?:{VERSION})?(?: licen[cs]e)?"),
    ("licence", 3, 0.6, " licen", "(?:the )?", " licen[cs]e"),
    ("versioned", 3, 0.7, " ", "", VERSION),
    ("name", 4, 0.4, " ", "", ""),
)
LEVELS = 4
BASE_LEVEL = 4

RULE_FIELDS = ("label", "keyword", "form", "pattern", "level", "weight", "base")
SPAN = "struct<start:int,back:int,level:int,rule:int>"
FIRST, LAST = "\x01", "\x02"  # marks before and after a match; no word holds them
CHUNK = 128  # detections folded at a time, so that what a fold has gathered is copied within these only


def rules() -> list[tuple[str, str, str, str, int, float, bool]]:
    """All rules in the order in which they win: by priority, then as written."""
    out = [
        (label, keyword, form, f"(?<= )(?:{before})(?:{name}){after}(?= )", level, weight, False)
        for kind, level, weight, form, before, after in FORMS
        for label, keyword, name in FAMILIES
        if label not in PHRASE_ONLY or kind not in ("versioned", "name")
    ]
    phrases = BASE.items()
    return out + [(label, f" {p} ", " ", f"(?<= )(?:{p})(?= )", BASE_LEVEL, 0.5, True) for p, label in phrases]


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised(text: Column) -> Column:
    """Words with A-Z in lower case and one blank before and after each."""
    lower = F.translate(text, ascii_uppercase, ascii_lowercase)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, BETWEEN, " ")), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(text: Column, rule: Column) -> Column:
    """Where a rule matches, as intervals of words: matches are marked, and the marked words are numbered."""

    def numbered(words: Column, marked) -> Column:
        return F.filter(F.transform(words, lambda w, k: F.when(marked(w), k)), lambda k: k.isNotNull())

    def intervals(words: Column) -> Column:
        first = numbered(words, lambda w: F.startswith(w, F.lit(FIRST))).alias("first")
        last = numbered(words, lambda w: F.endswith(w, F.lit(LAST))).alias("last")
        return F.transform(
            F.arrays_zip(first, last),
            # The first of the words is the nothing before the first blank; ``back`` is the stop, falling.
            lambda p: F.struct(
                (p["first"] - 1).alias("start"), (-p["last"]).alias("back"), rule["level"].alias("level"), rule["number"].alias("rule")
            ),
        )

    marked = F.regexp_replace(text, rule["pattern"], F.lit(f"{FIRST}$0{LAST}"))
    return _once(
        marked,
        lambda m: F.when(F.contains(m, F.lit(FIRST)), _once(F.split(m, " "), intervals)).otherwise(
            F.array().cast(f"array<{SPAN}>")
        ),
    )


def _detections(text: Column, table: Column, keywords: Column) -> Column:
    """Intervals of all rules whose keyword the text contains, in order of place, falling length and rule."""

    def within(text: Column, found: Column) -> Column:
        admitted = F.filter(
            table, lambda r: F.array_contains(found, r["keyword"]) & F.array_contains(found, r["form"])
        )
        return F.array_sort(F.flatten(F.transform(admitted, lambda r: _spans(text, r))))

    return _once(text, lambda t: _once(F.filter(keywords, lambda k: F.contains(t, k)), lambda found: within(t, found)))


def _surviving(sorted_spans: Column) -> Column:
    """Spans that no span of the same or a higher priority contains.

    Spans are sorted by start, then by falling stop, level and rule, so that
    whatever contains a span stands before it: the furthest stop of each
    priority so far decides.  They are folded in chunks, which hand on the
    furthest stops.
    """
    levels = range(1, LEVELS + 1)
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, span: Column) -> Column:
        level, stop = span["level"], -span["back"]
        reached = F.greatest(*(F.when(level >= k, acc[f"m{k}"]).otherwise(-1) for k in levels), F.lit(-1))
        furthest = [
            F.when(level == k, F.greatest(acc[f"m{k}"], stop)).otherwise(acc[f"m{k}"]).alias(f"m{k}") for k in levels
        ]
        kept = F.when(reached >= stop, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(span)))
        return F.struct(*furthest, kept.alias("kept"))

    def chunk(acc: Column, at: Column) -> Column:
        start = F.struct(*(acc[f"m{k}"].alias(f"m{k}") for k in levels), none.alias("kept"))
        return _once(
            F.aggregate(F.slice(sorted_spans, at, F.lit(CHUNK)), start, step),
            lambda got: F.struct(
                *(got[f"m{k}"].alias(f"m{k}") for k in levels),
                F.concat(acc["chunks"], F.array(got["kept"])).alias("chunks"),
            ),
        )

    start = F.struct(*(F.lit(-1).alias(f"m{k}") for k in levels), F.array().cast(f"array<array<{SPAN}>>").alias("chunks"))
    places = F.sequence(F.lit(1), F.size(sorted_spans), F.lit(CHUNK))
    folded = F.flatten(F.aggregate(places, start, chunk)["chunks"])
    return F.when(F.size(sorted_spans) > 0, folded).otherwise(none)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, base, spans) for every row of ``docs``.

    ``base`` holds the places (start, stop, rule) of the base phrases, ``spans``
    the detections that survive.  A null, empty or wordless text has no words
    and no detections; rows that repeat an id are scanned each for itself; a
    null id keeps its row; other columns are ignored; an empty table gives no
    rows.  A text's time grows with its length times the rules that its keywords
    admit, and with its detections (sorted once), however many they are.
    ``rule`` is (label, level, weight, base).
    """
    known = rules()
    table = F.array(
        *(
            F.struct(*(F.lit(v).alias(n) for v, n in zip(r, RULE_FIELDS, strict=True)), F.lit(k).alias("number"))
            for k, r in enumerate(known)
        )
    )
    keywords = F.array(*(F.lit(k) for k in sorted({k for r in known for k in r[1:3]})))
    rows = docs.select(F.col(id_col), normalised(F.coalesce(text_col, F.lit(""))).alias("norm"))
    rows = rows.select(id_col, F.when(F.col("norm") == "  ", F.lit(" ")).otherwise(F.col("norm")).alias("norm"))
    rows = rows.withColumn("n_words", (_blanks(F.col("norm")) - 1).cast("long"))
    rows = rows.select(id_col, "n_words", _detections(F.col("norm"), table, keywords).alias("found"))
    rows = rows.withColumn("kept", _surviving(F.col("found")))
    told = F.array(
        *(
            F.struct(*(F.lit(r[RULE_FIELDS.index(n)]).alias(n) for n in ("label", "level", "weight", "base")))
            for r in known
        )
    )
    place = lambda s: F.struct(
        s["start"].alias("start"), (-s["back"]).alias("stop"), F.get(told, s["rule"]).alias("rule")
    )
    first_base = len(known) - len(BASE)  # base phrases are the last rules
    return rows.select(
        id_col,
        "n_words",
        F.transform(F.filter("found", lambda s: s["rule"] >= first_base), place).alias("base"),
        F.transform("kept", place).alias("spans"),
    )


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
    labels = lambda c: F.transform(c, lambda s: s["rule"]["label"])
    starts = F.transform("base", lambda s: s["start"])
    either = F.array_union(labels("base"), labels("spans"))
    weights = F.transform(F.concat("base", "spans"), lambda s: s["rule"]["weight"])
    return scanned.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.array_distinct(labels("base"))), ",").alias("base_labels"),
        F.array_join(F.sort_array(either), ",").alias("labels"),
        F.coalesce(F.array_max(weights), F.lit(0.0)).alias("score"),
        F.transform(
            "spans", lambda s: F.concat_ws(":", s["rule"]["label"], s["start"].cast("string"), s["stop"].cast("string"))
        ).alias("spans"),
    )

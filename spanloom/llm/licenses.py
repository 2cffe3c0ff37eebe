"""License scans: ordered signature rules.

A text becomes its lower-cased words joined by single spaces. A gate of a few
words passes few texts on; of those, each license one of whose keywords occurs runs
its rules, a few hundred regular expressions in all: FORMS around its name or
identifier, and phrases of its body. Every match is an interval with a priority
(0 exact identifier, 1 grant sentence or body, 2 bare name). Matches are sorted by start, longest first; one that lies inside
an earlier match of the same or a better priority is suppressed, in one pass.

Everything happens inside a row: no shuffle, no join.

Defined results: a null or empty text has no words, no places and no labels,
and a score of 0; repeated rows are judged row by row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, let, read, scanned

#: Phrases that always count, and their labels. Fixed values.
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}

#: label: (keyword that must occur, names in normalised words). Fixed values.
LICENSES = {
    "mit": ("mit", r"(?:expat )?mit(?: x11)? license"),
    "x11": ("x11", r"x11 license"),
    "apache": ("apache", r"apache(?: software)? license(?: version)?(?: [12](?: [01])?)?"),
    "gpl": ("general public", r"(?:gnu )?general public license(?: version)?(?: [123](?: 0)?)?"),
    "lgpl": ("lesser", r"(?:gnu )?(?:lesser|library) general public license(?: version)?(?: [23](?: [01])?)?"),
    "agpl": ("affero", r"(?:gnu )?affero general public license(?: version)?(?: [123](?: 0)?)?"),
    "gfdl": ("free documentation", r"(?:gnu )?free documentation license(?: version)?(?: 1 [123])?"),
    "bsd-2": ("bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) license"),
    "bsd-3": ("bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) license"),
    "bsd-4": ("bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) license"),
    "bsd": ("bsd", r"(?:bsd|berkeley) license"),
    "0bsd": ("0bsd", r"(?:zero clause bsd|0bsd) license"),
    "isc": ("isc", r"isc license"),
    "mpl": ("mozilla", r"mozilla public license(?: version)?(?: [12](?: [01])?)?"),
    "epl": ("eclipse", r"eclipse public license(?: version)?(?: [12](?: 0)?)?"),
    "edl": ("eclipse", r"eclipse distribution license(?: version)?(?: 1(?: 0)?)?"),
    "cddl": ("common development", r"common development and distribution license(?: version)?(?: 1(?: [01])?)?"),
    "cpl": ("common public", r"common public license(?: version)?(?: 1(?: 0)?)?"),
    "eupl": ("european union", r"european union public licen[cs]e(?: version)?(?: 1(?: [012])?)?"),
    "bsl": ("boost", r"boost software license(?: version)?(?: 1(?: 0)?)?"),
    "busl": ("business source", r"business source license(?: version)?(?: 1(?: 1)?)?"),
    "sspl": ("server side", r"server side public license(?: version)?(?: 1)?"),
    "zlib": ("zlib", r"(?:zlib|zlib libpng) license"),
    "libpng": ("libpng", r"libpng license"),
    "artistic": ("artistic", r"(?:clarified |perl )?artistic license(?: version)?(?: [12](?: 0)?)?"),
    "wtfpl": ("do what", r"do what the f\w+ you want to public license"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "ofl": ("open font", r"(?:sil )?open font license(?: version)?(?: 1(?: 1)?)?"),
    "odbl": ("open database", r"open database license(?: version)?(?: 1(?: 0)?)?"),
    "odc-by": ("open data commons", r"open data commons attribution license"),
    "psf": ("python", r"python software foundation license(?: version)?(?: 2)?"),
    "php": ("php", r"php license(?: version)?(?: 3(?: 01)?)?"),
    "ruby": ("ruby", r"ruby(?: s)? license"),
    "openssl": ("openssl", r"openssl license"),
    "postgresql": ("postgresql", r"postgresql licen[cs]e"),
    "vim": ("vim", r"vim license"),
    "ms-pl": ("microsoft", r"microsoft public license"),
    "ms-rl": ("microsoft", r"microsoft reciprocal license"),
    "qpl": ("q public", r"q public license"),
    "cc0": ("cc0", r"(?:cc0|creative commons zero)(?: 1 0)?"),
    "cc-by": ("cc by", r"cc by(?: [1234] 0)?(?! (?:sa|nd|nc))"),
    "cc-by-sa": ("cc by sa", r"cc by sa(?: [1234] 0)?"),
    "cc-by-nd": ("cc by nd", r"cc by nd(?: [1234] 0)?"),
    "cc-by-nc": ("cc by nc", r"cc by nc(?: [1234] 0)?(?! (?:sa|nd))"),
    "cc-by-nc-sa": ("cc by nc sa", r"cc by nc sa(?: [1234] 0)?"),
    "cc-by-nc-nd": ("cc by nc nd", r"cc by nc nd(?: [1234] 0)?"),
    "creative-commons": ("creative commons", r"creative commons(?: attribution)?(?: non ?commercial)?(?: share ?alike| no ?derivatives)?(?: [1234] 0)?(?: international| unported)? license"),
    "public-domain": ("public domain", r"public domain"),
    "proprietary": ("rights reserved", r"all rights reserved"),
}
_LATER = r"(?: only| or later)?"
#: label: (keywords of which one must occur, identifiers in normalised words: SPDX's and common short ones). Fixed values.
IDS = {
    "mit": (["mit"], r"mit(?: 0)?"),
    "x11": (["x11"], r"x11"),
    "apache": (["apache", "asl"], r"(?:apache|asl)(?: version)? ?v?(?:1 [01]|2(?: 0)?)"),
    "gpl": (["gpl"], r"(?:gnu )?gpl(?:(?: version)? ?v?[123](?: 0)?)?" + _LATER),
    "lgpl": (["lgpl"], r"(?:gnu )?lgpl(?:(?: version)? ?v?[23](?: [01])?)?" + _LATER),
    "agpl": (["agpl"], r"(?:gnu )?agpl(?:(?: version)? ?v?[13](?: 0)?)?" + _LATER),
    "gfdl": (["fdl"], r"(?:gnu )?g?fdl(?: ?v?1 [123])?" + _LATER),
    "bsd-2": (["bsd"], r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)"),
    "bsd-3": (["bsd"], r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)"),
    "bsd-4": (["bsd"], r"(?:original bsd|bsd 4 clause|4 clause bsd)"),
    "bsd": (["bsd"], r"bsd(?! [234] clause)"),
    "0bsd": (["0bsd", "zero clause"], r"(?:0bsd|zero clause bsd)"),
    "isc": (["isc"], r"isc"),
    "mpl": (["mpl"], r"mpl(?: ?v?[12](?: [01])?)?"),
    "epl": (["epl"], r"epl(?: ?v?[12](?: 0)?)?"),
    "edl": (["edl"], r"edl(?: ?v?1(?: 0)?)?"),
    "cddl": (["cddl"], r"cddl(?: ?v?1(?: [01])?)?"),
    "cpl": (["cpl"], r"cpl(?: ?v?1(?: 0)?)?"),
    "eupl": (["eupl"], r"eupl(?: ?v?1 [012])?"),
    "bsl": (["bsl", "boost"], r"(?:bsl 1 0|boost)"),
    "busl": (["busl", "bsl"], r"(?:busl(?: 1 1)?|bsl 1 1)"),
    "sspl": (["sspl"], r"sspl(?: ?v?1(?: 0)?)?"),
    "zlib": (["zlib"], r"zlib"),
    "libpng": (["libpng"], r"libpng(?: 2 0)?"),
    "artistic": (["artistic"], r"artistic [12] 0(?: perl| cl8)?"),
    "wtfpl": (["wtfpl"], r"wtfpl"),
    "unlicense": (["unlicense"], r"unlicense"),
    "ofl": (["ofl"], r"(?:sil )?ofl(?: ?v?1 [01])?"),
    "odbl": (["odbl"], r"odbl(?: 1 0)?"),
    "odc-by": (["odc by"], r"odc by(?: 1 0)?"),
    "psf": (["psf", "python 2 0"], r"(?:psf(?: 2 0)?|python 2 0(?: 1)?)"),
    "php": (["php 3"], r"php 3 01?"),
    "ruby": (["ruby"], r"ruby"),
    "openssl": (["openssl"], r"openssl"),
    "postgresql": (["postgresql"], r"postgresql"),
    "vim": (["vim"], r"vim"),
    "ms-pl": (["ms pl"], r"ms pl"),
    "ms-rl": (["ms rl"], r"ms rl"),
    "qpl": (["qpl"], r"qpl(?: 1 0)?"),
}
#: Licenses whose identifiers count on their own, too. Fixed values.
ALONE = ("apache", "gpl", "lgpl", "agpl", "bsd-2", "bsd-3", "bsd-4", "0bsd")
_GNU = r"you (?:can|may) redistribute it and or modify it under the terms of (?:version [123](?: [01])? of )?the gnu "
#: label: (keyword, phrase of the license's body or usual notice). Fixed values.
BODIES = {
    "mit": ("person obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation(?: files)?"),
    "bsl": ("person or organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    "isc": ("with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    "0bsd": ("with or without fee", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    "bsd": ("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    "bsd-3": ("endorse or promote", r"neither the names? of (?:\w+ ){1,20}?(?:nor the names of (?:its|other|any) (?:\w+ ){0,3}?contributors )?may be used to endorse or promote products"),
    "bsd-4": ("advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    "apache": ("on an as is basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    "gpl": ("redistribute it", _GNU + r"general public license"),
    "lgpl": ("redistribute it", _GNU + r"(?:lesser|library) general public license"),
    "agpl": ("redistribute it", _GNU + r"affero general public license"),
    "mpl": ("source code form", r"this source code form is subject to the terms of the mozilla public license"),
    "epl": ("eclipse public", r"made available under the terms of the eclipse public license"),
    "zlib": ("will the authors be held", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    "unlicense": ("unencumbered", r"this is free and unencumbered software released into the public domain"),
    "cc0": ("dedicated the work", r"associated a work with this deed has dedicated the work to the public domain"),
    "ofl": ("licensed fonts", r"the ofl allows the licensed fonts to be used studied modified and redistributed freely"),
}
#: (priority, score, form around a license's name or identifier). Fixed values.
FORMS = [
    (0, 1.0, r"spdx license identifier {name}"),
    (1, 0.95, r"(?:is |are )?(?:dual )?licen[cs]ed under(?: the terms of)?(?: the| a| an)? {name}"),
    (1, 0.95, r"(?:is |are )?(?:released|published|provided|available|made available) under(?: the terms of)?(?: the| a| an)? {name}"),
    (1, 0.95, r"(?:re)?distributed under(?: the terms of)?(?: the| a| an)? {name}"),
    (1, 0.9, r"(?:subject to|governed by|covered by)(?: the terms of)?(?: the| a| an)? {name}"),
]
#: (priority, score, form) around a name alone.
NAME_FORMS = [(1, 0.9, r"dedicated to the {name}"), (2, 0.6, r"{name}")]
#: A text without any of these has no match: each name, form, identifier that counts alone or body holds one.
GATE = ["licen", "reserved", "domain", "cc0", "spdx", "cc", "released", "published", "provided", "available", "distribut", "subject", "governed", "covered", "hereby", "endorse", "advertising", "liable", "gpl", "apache", "asl", "bsd"]


MATCH = "struct<s:int,ne:int,priority:int,label:string,score:double>"


def signatures() -> list[tuple[str, list[str], list[tuple[int, float, str]]]]:
    """label, keywords and rules of every license."""

    def rules(label: str, name: str) -> list[tuple[int, float, str]]:
        every, bare = f"(?:{name})", f"(?:{name})"
        if label in IDS:
            own = f"(?:{IDS[label][1]})"
            every = f"(?:{name}|{own}(?: licen[cs]e)?)"
            bare = f"(?:{name}|{own}{'(?: licen[cs]e)?' if label in ALONE else ' licen[cs]e'})"
        found = [(p, s, form.replace("{name}", every)) for p, s, form in FORMS] + [(p, s, form.replace("{name}", bare)) for p, s, form in NAME_FORMS]
        found += [(1, 0.9, BODIES[label][1])] if label in BODIES else []
        return [(p, s, rf"\b{r}\b") for p, s, r in found]

    keys = lambda label, key: list(dict.fromkeys([key, *(["library general"] if label == "lgpl" else []), *(["berkeley"] if label == "bsd" else []), *(["zero clause"] if label == "0bsd" else []), *(IDS[label][0] if label in IDS else []), *([BODIES[label][0]] if label in BODIES else []), *(["creative commons zero"] if label == "cc0" else [])]))
    return [(label, keys(label, key), rules(label, name)) for label, (key, name) in LICENSES.items()]


def _intervals(text: Column, pattern: Column) -> Column:
    """Start and end of every match, from the pieces between matches."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    place = lambda s, e: F.struct(s.alias("s"), e.alias("e"))

    def walk(both: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            return let(a["e"] + F.length(x["p"]), lambda s: place(s, s + F.length(x["f"])))

        pairs = F.zip_with(both["f"], F.slice(both["p"], F.lit(1), F.size(both["f"])), lambda f, p: F.struct(f.alias("f"), p.alias("p")))
        return let(pairs, lambda x: scanned(x, place(F.lit(0), F.lit(0)), step, lambda a: a, "struct<s:int,e:int>"))

    return let(F.struct(found.alias("f"), between.alias("p")), walk)


def _matches(text: Column) -> Column:
    """Kept matches of one normalised text, sorted by start: s, ne (end, negated), priority, label, score.

    Whether a license's rules match at all is told by one literal alternation of them, compiled once; only then do the rules run one by one.
    """
    every = signatures()
    rules = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(s).alias("score"), F.lit(r).alias("regex")) for p, s, r in forms]).alias("forms")) for label, _, forms in every])
    some = F.array(*[reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keys]) & text.rlike("|".join(r for *_, r in forms)) for _, keys, forms in every])
    of = lambda r: F.flatten(F.transform(r["forms"], lambda f: F.transform(_intervals(text, f["regex"]), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), f["priority"].alias("priority"), r["label"].alias("label"), f["score"].alias("score")))))
    hits = F.flatten(F.transform(let(some, lambda found: F.filter(rules, lambda r, k: F.get(found, k))), of))
    zero = F.struct(*[F.lit(-1).alias(f"m{p}") for p in range(3)], F.lit(None).cast(MATCH).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        e = -x["ne"]
        reach = F.when(x["priority"] == 0, a["m0"]).when(x["priority"] == 1, a["m1"]).otherwise(a["m2"])
        most = lambda p: F.when(x["priority"] <= p, F.greatest(a[f"m{p}"], e)).otherwise(a[f"m{p}"]).alias(f"m{p}")
        return F.struct(most(0), most(1), most(2), F.when(reach < e, x).alias("kept"))

    return F.array_compact(let(F.sort_array(hits), lambda h: scanned(h, zero, step, lambda a: a["kept"], MATCH)))


def _places(words: Column) -> Column:
    """Where a phrase's words stand consecutively: i and label."""
    at = lambda w, i, phrase: F.coalesce(F.lit(True) & (F.get(w, i) == phrase[0]) & (F.get(w, i + 1) == phrase[1]) & (F.lit(True) if len(phrase) < 3 else F.get(w, i + 2) == phrase[2]), F.lit(False))

    def of(w: Column) -> Column:
        seq = F.when(F.size(w) >= 2, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
        label = lambda i: F.coalesce(*[F.when(at(w, i, p), F.lit(k)) for k, p in PHRASES.items()])
        return F.filter(F.transform(seq, lambda i: F.struct(i.alias("i"), label(i).alias("label"))), lambda x: x["label"].isNotNull())

    return let(words, of)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places (of the phrases) and matches (of the rules) for every row."""
    low = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    w = low.select("doc_id", F.array_remove(F.split("low", NON_WORD), "").alias("w"), *[F.contains("low", F.lit(g)).alias(f"g{k}") for k, g in enumerate(GATE)])
    gate = F.lit(False)
    for k in range(len(GATE)):
        gate = gate | F.col(f"g{k}")
    no_match = F.array().cast(f"array<{MATCH}>")
    return w.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.when(F.col("g0"), _places(F.col("w"))).otherwise(F.array().cast("array<struct<i:int,label:string>>")).alias("places"),
        F.when(gate, let(F.array_join("w", " "), _matches)).otherwise(no_match).alias("matches"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    every = F.array_distinct(F.concat(base, F.transform("matches", lambda x: x["label"])))
    best = F.array_max(F.concat(F.transform("matches", lambda x: x["score"]), F.when(F.size("places") > 0, F.array(F.lit(0.6))).otherwise(F.array(F.lit(0.0)))))
    starts = F.transform("places", lambda x: x["i"])
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), F.round(best, 4).alias("score"))

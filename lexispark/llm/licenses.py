"""License scans: TF-IDF cosine and containment of templates, then the nearest directory's license. DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.runtime import read_table

#: The sentences by which the licenses ask to be named in headers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
CUE = "(?i)licen[cs]e|redistribution"
SPLIT = "[^a-z0-9]+"
THRESHOLD = 0.6

#: Patterns of the words by which a header, SPDX line or title names a license: in lower case, with one space between words.
_GRANT = "(?:licensed|released|distributed|available|provided|published|redistribute it and or modify it) under (?:the )?(?:terms of )?(?:the )?"
_GNU, _OF = "gnu {}general public license", "(?: as published by the free software foundation)?(?: either)? (?:version |v ?)"


def _names(title: str, spdx: str, opening: str | None = None) -> str:
    """A grant under a title, its SPDX line, or, if given, the words that open its text."""
    return f"{_GRANT}(?:{title})|spdx license identifier (?:{spdx})" + (f"|{opening}" if opening else "")


def _gnu(kind: str, short: str, version: str, date: str) -> str:
    name, number = _GNU.format(kind), version.replace(".", " ")
    return _names(f"{name}{_OF}{number}(?! [0-9] )|{short} ?v?{number}", f"{short} {number}", f"{name} version {number} {date}")


FORMS = {
    "AGPL-3.0": _gnu("affero ", "agpl", "3", "19 november 2007"),
    "Apache-2.0": _names("apache license (?:version |v ?)?2 0|apache 2 0", "apache 2 0", "apache license version 2 0 january 2004"),
    "BSD-2-Clause": _names("bsd 2 clause|2 clause bsd|simplified bsd", "bsd 2 clause", "bsd 2 clause license copyright"),
    "BSD-3-Clause": _names("bsd 3 clause|3 clause bsd|(?:new|modified) bsd", "bsd 3 clause", "bsd 3 clause license copyright"),
    "CC-BY-3.0": _names("(?:a )?creative commons attribution 3 0|cc by 3 0", "cc by 3 0"),
    "CC-BY-4.0": _names("(?:a )?creative commons attribution 4 0|cc by 4 0", "cc by 4 0", "creative commons attribution 4 0 international public license"),
    "CC-BY-NC-4.0": _names("(?:a )?creative commons attribution non ?commercial 4 0|cc by nc 4 0", "cc by nc 4 0", "creative commons attribution noncommercial 4 0 international public license"),
    "CC-BY-SA-4.0": _names("(?:a )?creative commons attribution share ?alike 4 0|cc by sa 4 0", "cc by sa 4 0", "creative commons attribution sharealike 4 0 international public license"),
    "CC0-1.0": _names("cc0|creative commons zero", "cc0 1 0", "cc0 1 0 universal"),
    "GPL-2.0": _gnu("", "gpl", "2", "june 1991"),
    "GPL-3.0": _gnu("", "gpl", "3", "29 june 2007"),
    "ISC": _names("isc license", "isc", "isc license copyright"),
    "LGPL-2.1": _gnu("lesser ", "lgpl", "2.1", "february 1999"),
    "LGPL-3.0": _gnu("lesser ", "lgpl", "3", "29 june 2007"),
    "MIT": _names("mit license", "mit", "mit license copyright"),
    "MPL-1.1": _names("mozilla public license (?:version |v )?1 1", "mpl 1 1", "subject to the mozilla public license version 1 1"),
    "MPL-2.0": _names("mozilla public license (?:version |v )?2 0", "mpl 2 0", "subject to the terms of the mozilla public license (?:version |v )2 0|mozilla public license version 2 0 1 definitions"),
    "Unlicense": _names("the unlicense|unlicense", "unlicense", "this is free and unencumbered software released into the public domain"),
}
#: No license, but a claim: it counts where no license is named.
RESERVED, RESERVED_FORM = "All-Rights-Reserved", "all rights reserved"
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
#: License texts, of which a window must hold the words named first and most of the rest. BSD's third clause makes the difference.
_CLAUSE = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"
TEXTS = {"BSD-2-Clause": ("redistribution binary", _BSD), "BSD-3-Clause": ("redistribution neither endorse", _BSD + _CLAUSE), "ISC": ("permission fee", _ISC), "MIT": ("hereby sublicense", _MIT)}
NAMES = sorted({*FORMS, *TEMPLATES, *TEXTS, RESERVED})
#: Least share of a license text's weight in a window; a text that holds none of these words has no template's.
CONTAINED = 0.8
WIDE_CUE = CUE + "|rights[^a-z0-9]+reserved|permission[^a-z0-9]+(?:is|to)|public[^a-z0-9]+domain|creative[^a-z0-9]+commons|cc0"


def _terms(text: str) -> list[str]:
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return out.split()


def weights() -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Inverse document frequencies over the templates, and each template's unit vector."""
    counts = {k: Counter(_terms(t)) for k, t in TEMPLATES.items()}
    df = Counter(x for c in counts.values() for x in c)
    idf = {x: round(math.log((1 + len(counts)) / (1 + n)) + 1, 9) for x, n in sorted(df.items())}
    vectors = {}
    for k, c in counts.items():
        norm = math.sqrt(sum((n * idf[x]) ** 2 for x, n in c.items()))
        vectors[k] = {x: round(n * idf[x] / norm, 9) for x, n in sorted(c.items())}
    return idf, vectors


IDF, VECTORS = weights()
#: Of a term that no template has.
RARE = round(math.log(1 + len(TEMPLATES)) + 1, 9)


def line_match(line: Column) -> Column:
    """Struct (score, license) of the most similar template; ties go to the first name."""
    tokens = F.filter(F.split(F.lower(line), SPLIT), lambda t: t != "")
    idf, vectors = F.create_map(*(F.lit(x) for kv in IDF.items() for x in kv)), {k: F.create_map(*(F.lit(x) for kv in v.items() for x in kv)) for k, v in VECTORS.items()}
    terms = F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("t"), (F.size(F.filter(tokens, lambda u: u == t)) * F.coalesce(F.element_at(idf, t), F.lit(RARE))).alias("w")))
    norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))

    def cosine(k: str) -> Column:
        dot = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.element_at(vectors[k], x["t"]), F.lit(0.0)))
        return F.struct(F.round(F.when(norm > 0, dot / norm).otherwise(F.lit(0.0)), 6).alias("score"), F.lit(-NAMES.index(k)).alias("order"), F.lit(k).alias("license"))

    return F.array_max(F.array(*map(cosine, TEMPLATES)))


def _let(x: Column, then) -> Column:
    """`then` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _match(score: Column, k: str) -> Column:
    """A match as `line_match` gives it."""
    return F.struct(score.alias("score"), F.lit(-NAMES.index(k)).alias("order"), F.lit(k).alias("license"))


def text_score(tokens: Column, k: str) -> Column:
    """Largest share of a license text's weight in windows that overlap by half and are twice its length."""
    must, body = TEXTS[k]
    terms, need, n = sorted(set(_terms(body))), F.array(*map(F.lit, must.split())), len(_terms(body))
    idf = F.create_map(*(F.lit(x) for t in terms for x in (t, IDF.get(t, RARE))))
    total = sum(IDF.get(t, RARE) for t in terms)
    words = F.array(*map(F.lit, terms))

    def share(i: Column) -> Column:
        found = F.array_intersect(F.slice(tokens, i * n + 1, 2 * n), words)
        weight = F.aggregate(found, F.lit(0.0), lambda a, t: a + F.element_at(idf, t))
        return F.when(F.size(F.array_except(need, found)) == 0, F.round(weight / total, 6)).otherwise(F.lit(0.0))

    windows = F.sequence(F.lit(0), F.floor(F.size(tokens) / n).cast("int"))
    return F.when(F.size(F.array_except(need, tokens)) == 0, F.array_max(F.transform(windows, share))).otherwise(F.lit(0.0))


def own_license(text: Column, threshold: float = THRESHOLD) -> Column:
    """Struct (named, score, order, license) of the best match in the whole text; else null.

    A match is a line that has a cue and whose cosine to a template reaches
    the threshold, a form of a name in consecutive words, whatever lies between them or
    on which lines they are (score 1), or a window that holds most of a
    license text. A claim of all rights counts only where no license is named.
    """
    nothing = F.lit(None).cast("struct<score:double,order:int,license:string>")

    def windows(tokens: Column) -> Column:
        scores = F.array(*(_match(text_score(tokens, k), k) for k in TEXTS))
        # a text that holds a shorter one's whole is the longer one
        three = F.exists(scores, lambda m: (m["license"] == "BSD-3-Clause") & (m["score"] >= CONTAINED))
        return F.filter(scores, lambda m: (m["score"] >= CONTAINED) & ~((m["license"] == "BSD-2-Clause") & three))

    def best(flat: Column) -> Column:
        lines = F.filter(F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(CUE)), line_match), lambda m: m["score"] >= threshold)
        forms = F.array(*(F.when(flat.rlike(f" (?:{form}) "), _match(F.lit(1.0), k)).otherwise(nothing) for k, form in FORMS.items()))
        found = F.concat(lines, F.filter(forms, lambda m: m.isNotNull()), _let(F.filter(F.split(flat, " "), lambda t: t != ""), windows))
        claim = F.when(flat.rlike(f" {RESERVED_FORM} "), F.struct(F.lit(0).alias("named"), F.lit(1.0).alias("score"), F.lit(-NAMES.index(RESERVED)).alias("order"), F.lit(RESERVED).alias("license")))
        named = F.transform(found, lambda m: F.struct(F.lit(1).alias("named"), m["score"].alias("score"), m["order"].alias("order"), m["license"].alias("license")))
        return F.coalesce(F.array_max(named), claim)

    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), SPLIT, " "), F.lit(" "))
    return F.when(text.rlike(WIDE_CUE), _let(flat, best))


def ancestors(path: Column) -> Column:
    """Directories above a path, from the top ("") down, with their depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))


def scan_licenses(df: DataFrame, path: Column, is_licence_file: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, path, license, score, origin ("own", "inherited" or "none"), from_dir.

    A file's own license is that of its best match. A directory's license is
    that of the licence file directly in it (of several, one that names a
    license, then the highest score, then the first license by name). Other files take that of
    the nearest directory above them. Only distinct directories meet their
    ancestors, so the root is met once for each directory and not for each
    file; files then join their directory's verdict, of which there is one, so that Spark may
    split a hot directory's files. Null texts and paths are empty. Rows that
    repeat are a row each, with or without a license and an id. An
    empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(is_licence_file, F.lit(False)).alias("is_file"), own_license(F.coalesce(F.col(text_col), F.lit(""))).alias("own"))
    rows = rows.withColumn("ups", ancestors(F.col("path"))).withColumn("folder", F.element_at("ups", -1)["dir"])
    dirs = rows.filter("is_file AND own IS NOT NULL").groupBy(F.col("folder").alias("dir")).agg(F.max("own").alias("given"))
    folders = df.select(ancestors(F.coalesce(path, F.lit(""))).alias("ups")).select(F.element_at("ups", -1)["dir"].alias("folder"), "ups").distinct()
    above = folders.select("folder", F.explode("ups").alias("up")).select("folder", "up.depth", "up.dir")
    nearest = above.join(dirs, "dir").groupBy("folder").agg(F.max(F.struct("depth", "dir", "given")).alias("got"))
    found = rows.join(nearest, "folder", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("got").isNotNull(), "inherited").otherwise("none")
    best = F.coalesce("own", "got.given")
    from_dir = F.when(F.col("own").isNull(), F.col("got.dir"))
    return found.select(F.col("id").alias(id_col), "path", best["license"].alias("license"), best["score"].alias("score"), origin.alias("origin"), from_dir.alias("from_dir"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in source/id div 500/id div 20; each first one in a folder of twenty or of 500 serves as its licence file."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    n = F.col("doc_id")
    shard, part = F.floor(n / 500).cast("string"), F.floor(n / 20).cast("string")
    path = F.when(n % 20 == 1, F.concat_ws("/", "source", shard, n.cast("string"))).otherwise(F.concat_ws("/", "source", shard, part, n.cast("string")))
    return scan_licenses(docs, path, (n % 20 == 1) | (n % 4 == 0))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def _form_sql(license: str) -> str:
    """Documents with a form of a name. DuckDB's patterns can't look ahead, so what must not follow a number is spelt out."""
    form, ahead = FORMS[license], "(?! [0-9] )"
    parts = [f"regexp_matches(flat, ' (?:{form.replace(ahead, '')}) ')"]
    if ahead in form:
        versioned, rest = form.split(f"{ahead}|", 1)
        grant = versioned.index(f"{_GNU.split('{')[0]}")
        parts = [f"regexp_matches(flat, ' {versioned[:grant]}{versioned[grant:]}) (?:$|[^0-9]|[0-9][^ ])')", f"regexp_matches(flat, ' (?:{versioned[:grant]}{rest}) ')"]
    return f"SELECT doc_id, '{license}' AS license, 1.0::DOUBLE AS score FROM flat WHERE {' OR '.join(parts)}"


_TOKENS = "list_filter(regexp_split_to_array(lower({}), '" + SPLIT + "'), lambda x: x <> '')"
_NAMED = "list_position([" + ", ".join(f"'{n}'" for n in NAMES) + "], license)"

#: Weights are worked out from the templates in SQL, and so are lines, windows, forms and directories.
SQL = f"""
WITH source(license, body) AS (VALUES {_values(TEMPLATES.items())}),
source_t AS (SELECT license, t, count(*) AS c FROM (SELECT license, unnest({_TOKENS.format("body")}) AS t FROM source) GROUP BY license, t),
idf AS (SELECT t, round(ln((1.0 + {len(TEMPLATES)}) / (1 + count(*))) + 1, 9) AS i FROM source_t GROUP BY t),
tpl AS (SELECT license, t, round(c * i / sqrt(sum((c * i) ** 2) OVER (PARTITION BY license)), 9) AS w FROM source_t JOIN idf USING (t)),
rare AS (SELECT round(ln(1.0 + {len(TEMPLATES)}) + 1, 9) AS r),
body AS (SELECT license, string_split(must, ' ') AS must, {_TOKENS.format("body")} AS ts FROM (VALUES {_values((k, *v) for k, v in TEXTS.items())}) v(license, must, body)),
body_w AS (SELECT license, t, coalesce(i, r) AS w FROM (SELECT license, unnest(list_distinct(ts)) AS t FROM body) LEFT JOIN idf USING (t), rare),
total AS (SELECT license, sum(w) AS total FROM body_w GROUP BY license),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, doc_id % 20 = 1 OR doc_id % 4 = 0 AS is_file,
    CASE WHEN doc_id % 20 = 1 THEN concat_ws('/', source, (doc_id // 500)::VARCHAR) ELSE concat_ws('/', source, (doc_id // 500)::VARCHAR, (doc_id // 20)::VARCHAR) END AS folder
  FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d WHERE regexp_matches(text, '{CUE}')),
cued AS (SELECT doc_id, row_number() OVER () AS n, lower(line) AS line FROM lines WHERE regexp_matches(line, '{CUE}')),
tok AS (SELECT doc_id, n, unnest(regexp_split_to_array(line, '{SPLIT}')) AS t FROM cued),
w AS (SELECT doc_id, n, tok.t, count(*) * coalesce(any_value(i), any_value(r)) AS w FROM tok LEFT JOIN idf USING (t), rare WHERE tok.t <> '' GROUP BY doc_id, n, tok.t),
norm AS (SELECT n, sqrt(sum(w * w)) AS norm FROM w GROUP BY n),
cosines AS (SELECT doc_id, license, round(sum(w.w * tpl.w) / any_value(norm), 6) AS score FROM w JOIN tpl USING (t) JOIN norm USING (n) GROUP BY doc_id, n, license),
flat AS MATERIALIZED (SELECT doc_id, ' ' || regexp_replace(lower(text), '{SPLIT}', ' ', 'g') || ' ' AS flat FROM d WHERE regexp_matches(text, '{WIDE_CUE}')),
forms AS ({" UNION ALL ".join(map(_form_sql, FORMS))}),
toks AS (SELECT doc_id, list_filter(string_split(flat, ' '), lambda x: x <> '') AS ts FROM flat),
windows AS (
  SELECT doc_id, license, i, must, w.ts[i * n + 1 : i * n + 2 * n] AS part FROM (
    SELECT doc_id, license, must, len(body.ts) AS n, toks.ts, unnest(range(0, len(toks.ts) // len(body.ts) + 1)) AS i FROM toks, body WHERE list_has_all(toks.ts, must)) w),
shares AS (
  SELECT doc_id, license, i, round(sum(w) / any_value(total), 6) AS score
  FROM (SELECT doc_id, license, i, unnest(list_distinct(part)) AS t FROM windows WHERE list_has_all(part, must)) JOIN body_w USING (license, t) JOIN total USING (license) GROUP BY doc_id, license, i),
texts AS (SELECT doc_id, license, max(score) AS score FROM shares GROUP BY doc_id, license HAVING max(score) >= {CONTAINED}),
named AS (
  SELECT doc_id, license, score FROM cosines WHERE score >= {THRESHOLD} UNION ALL SELECT * FROM forms
  UNION ALL SELECT doc_id, license, score FROM texts WHERE license <> 'BSD-2-Clause' OR doc_id NOT IN (SELECT doc_id FROM texts WHERE license = 'BSD-3-Clause')),
claims AS (SELECT 1 AS named, * FROM named UNION ALL SELECT 0, doc_id, '{RESERVED}', 1.0 FROM flat WHERE contains(flat, ' {RESERVED_FORM} ')),
own AS (
  SELECT doc_id, license, score, named FROM claims
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY named DESC, score DESC, {_NAMED}) = 1),
dirs AS (
  SELECT folder, license, score FROM own JOIN d USING (doc_id) WHERE is_file
  QUALIFY row_number() OVER (PARTITION BY folder ORDER BY named DESC, score DESC, {_NAMED}) = 1),
up AS (
  SELECT doc_id, folder, unnest([0, 1, 2, 3]) AS depth FROM d WHERE doc_id NOT IN (SELECT doc_id FROM own)),
got AS (
  SELECT doc_id, dirs.folder AS from_dir, dirs.license, score FROM up
  JOIN dirs ON depth <= len(string_split(up.folder, '/')) AND dirs.folder = array_to_string(string_split(up.folder, '/')[:depth], '/')
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC) = 1)
SELECT doc_id, folder || '/' || doc_id AS path, coalesce(own.license, got.license) AS license, coalesce(own.score, got.score) AS score,
       CASE WHEN own.doc_id IS NOT NULL THEN 'own' WHEN got.doc_id IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, from_dir
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN got USING (doc_id)
"""

"""Licence recognition by sentence rules.

A text is cut into sentences; a sentence, normalised to lower-case letters and digits with single spaces, may be a
known licence sentence and then stands as its identifier. A document so becomes a sequence of identifiers, with a mark
for everything else. Ordered rules, each a licence and a sequence of identifiers, are matched against it: a rule takes
all places where its identifiers follow each other, and what is taken is not there for the rules after it. Longer
rules come before the shorter ones they hold, so that a full licence text is one match.

Sentences end at `.`, `!` or `?` before white space, or at a line without words. The number of a list item, after such
an end or after `:` or `;`, is no part of a sentence, nor is `neither the name of ... nor`, which holds a name. A sentence that is unknown as a whole is
looked up line by line, so wrapped licence texts and licence lines after unfinished lines are both found. All of it is
column expressions; a word filter that every known sentence passes spares the others their normalisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x09-\x0D\x20]"
#: White space and the signs that begin comment lines and list items.
SIGNS = r"[\x09-\x0D\x20*#/;%-]"
NUMBER = rf"\(?(?:[0-9]{{1,2}}|[a-zA-Z]|[ivx]{{2,4}})[.)]+{BLANKS}+"
NEITHER = rf"(?i:neither{SIGNS}+the{SIGNS}+names?{SIGNS}+of){SIGNS}[^!?]{{1,200}}?{SIGNS}(?i:nor){SIGNS}+"
SENTENCE_END = (
    rf"(?:[.!?]+{BLANKS}{SIGNS}*|\n[\x09\x0B-\x0D\x20*#/;%-]*\n{SIGNS}*)(?:{NUMBER})?(?:{NEITHER})?"
    rf"|[:;]{BLANKS}{SIGNS}*{NUMBER}(?:{NEITHER})?"
)
#: A line also begins after `copyright`, a year, a holder and the word all, so that `rights reserved` is left of it.
LINE_END = r"[\x0A\x0D]+|(?i:copyright|\(c\)|©)[^\x0A\x0D]{0,200}?[0-9]{4}[^\x0A\x0D]{0,200}?[^a-zA-Z0-9\x0A\x0D](?i:all)[\x09\x20]+"
OTHER = "-"

#: A known sentence holds one of these (in its normalised form and in the text, A-Z in any case).
HINTS = ("licen", "copyright", "permission", "warrant", "redistribut", "public domain", "rights reserved")

#: Known licence sentences by identifier, normalised (fixed values).
SENTENCES = {
    "mit_name": "released under the mit license",
    "mit_under": "licensed under the mit license",
    "mit_project": "this project is licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "apache_name": "licensed under the apache license version 2 0",
    "apache_short": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_obtain": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_joined": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache_asf": "the asf licenses this file to you under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache_obtain_https": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "apache_obtain_at": "you may obtain a copy of the license at",
    "apache_url": "http www apache org licenses license 2 0",
    "apache_url_https": "https www apache org licenses license 2 0",
    "apache_obtain_unless": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_obtain_https_unless": "you may obtain a copy of the license at https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_url_unless": "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_url_https_unless": "https www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3_name": "this work is licensed under the gnu general public license version 3",
    "gpl2_name": "this work is licensed under the gnu general public license version 2",
    "gpl3_terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "lgpl3_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl3_library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21_program": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl21_library": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl2_library": "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "agpl3_terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "library_hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_see": "see the gnu lesser general public license for more details",
    "library_see": "see the gnu library general public license for more details",
    "agpl_see": "see the gnu affero general public license for more details",
    "lgpl_name": "this work is licensed under the gnu lesser general public license version 3",
    "agpl_name": "this work is licensed under the gnu affero general public license version 3",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_joined": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_names": "the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_other_names": "the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_author": "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_name": "released under the bsd license",
    "mpl_name": "this source code form is subject to the terms of the mozilla public license v",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by_nd": "licensed under cc by nd 4 0",
    "cc_by_nc_sa": "licensed under cc by nc sa 4 0",
    "cc_by_nc_nd": "licensed under cc by nc nd 4 0",
    "cc_by_name": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "this work is dedicated to the public domain",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "spdx_mit": "spdx license identifier mit",
    "spdx_apache": "spdx license identifier apache 2 0",
    "spdx_gpl3": "spdx license identifier gpl 3 0 or later",
    "spdx_gpl2": "spdx license identifier gpl 2 0 only",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "all_rights": "this text may not be copied without written permission of the copyright holder",
    "all_rights_reserved": "all rights reserved",
    "rights_reserved": "rights reserved",
}

#: Ways in which the parts of notices are wrapped (fixed values).
APACHE_HEADS = [["apache_joined"], ["apache_short", "apache_comply"], ["apache_asf"]]
APACHE_TERMS = [
    ["apache_obtain", "apache_as_is"], ["apache_obtain_at", "apache_url", "apache_as_is"], ["apache_obtain_unless"], ["apache_obtain_at", "apache_url_unless"],
    ["apache_obtain_https", "apache_as_is"], ["apache_obtain_at", "apache_url_https", "apache_as_is"], ["apache_obtain_https_unless"], ["apache_obtain_at", "apache_url_https_unless"],
]
BSD_HEADS = [
    [*rights, *head, "bsd_binary"] for rights in (["all_rights_reserved"], ["rights_reserved"], []) for head in (["bsd_redistribution", "bsd_source"], ["bsd_joined"])
]

#: Rules in the order in which they are matched (fixed values).
RULES = [
    ("MIT", ["mit_grant", "as_is"]),
    ("MIT", ["mit_permission", "mit_notice", "as_is"]),
    *[("Apache-2.0", [*head, *terms, "apache_see"]) for head in APACHE_HEADS for terms in APACHE_TERMS],
    ("GPL-3.0-or-later", ["gpl3_terms", "gpl_hope", "gpl_see"]),
    ("GPL-2.0-or-later", ["gpl2_terms", "gpl_hope", "gpl_see"]),
    ("LGPL-3.0-or-later", ["lgpl3_program", "gpl_hope", "lgpl_see"]),
    ("LGPL-3.0-or-later", ["lgpl3_library", "library_hope", "lgpl_see"]),
    ("LGPL-2.1-or-later", ["lgpl21_program", "gpl_hope", "lgpl_see"]),
    ("LGPL-2.1-or-later", ["lgpl21_library", "library_hope", "lgpl_see"]),
    ("LGPL-2.0-or-later", ["lgpl2_library", "library_hope", "library_see"]),
    ("AGPL-3.0-or-later", ["agpl3_terms", "gpl_hope", "agpl_see"]),
    *[("BSD-3-Clause", [*head, last]) for head in BSD_HEADS for last in ("bsd_names", "bsd_other_names", "bsd_author")],
    *[("BSD-2-Clause", head) for head in BSD_HEADS],
    ("ISC", ["isc_permission", "as_is"]),
    ("MIT", ["mit_permission", "mit_notice"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_permission"]),
    ("MIT", ["mit_name"]),
    ("MIT", ["mit_under"]),
    ("MIT", ["mit_project"]),
    ("MIT", ["spdx_mit"]),
    *[("Apache-2.0", head) for head in APACHE_HEADS],
    ("Apache-2.0", ["apache_short"]),
    ("Apache-2.0", ["apache_as_is", "apache_see"]),
    *[("Apache-2.0", [*terms, *see]) for terms in APACHE_TERMS if terms[-1] != "apache_as_is" for see in (["apache_see"], [])],
    ("Apache-2.0", ["apache_as_is"]),
    ("Apache-2.0", ["apache_see"]),
    ("Apache-2.0", ["apache_name"]),
    ("Apache-2.0", ["spdx_apache"]),
    ("GPL-3.0-or-later", ["gpl3_terms"]),
    ("GPL-3.0-or-later", ["spdx_gpl3"]),
    ("GPL-3.0-only", ["gpl3_name"]),
    ("GPL-2.0-or-later", ["gpl2_terms"]),
    ("GPL-2.0-only", ["gpl2_name"]),
    ("GPL-2.0-only", ["spdx_gpl2"]),
    *[("LGPL-3.0-or-later", [terms]) for terms in ("lgpl3_program", "lgpl3_library")],
    *[("LGPL-2.1-or-later", [terms]) for terms in ("lgpl21_program", "lgpl21_library")],
    ("LGPL-2.0-or-later", ["lgpl2_library"]),
    ("AGPL-3.0-or-later", ["agpl3_terms"]),
    ("LGPL-3.0-only", ["lgpl_name"]),
    ("AGPL-3.0-only", ["agpl_name"]),
    ("BSD-3-Clause", ["spdx_bsd3"]),
    ("BSD", ["bsd_redistribution"]),
    ("BSD", ["bsd_joined"]),
    ("BSD", ["bsd_name"]),
    ("ISC", ["isc_permission"]),
    ("MPL-2.0", ["mpl_name"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("CC-BY-4.0", ["cc_by_name"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC-BY-ND-4.0", ["cc_by_nd"]),
    ("CC-BY-NC-SA-4.0", ["cc_by_nc_sa"]),
    ("CC-BY-NC-ND-4.0", ["cc_by_nc_nd"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("All-rights-reserved", ["all_rights"]),
    ("All-rights-reserved", ["all_rights_reserved"]),
    ("All-rights-reserved", ["rights_reserved"]),
]

_NUMBER = {name: i + 1 for i, name in enumerate(SENTENCES)}


def sequence(identifiers: list[str]) -> str:
    return "".join(f"<{_NUMBER[i]}>" for i in identifiers)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def _identifier(sentence: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, SENTENCES.values())), normalised(sentence))
    return F.when(at > 0, F.concat(F.lit("<"), at.cast("string"), F.lit(">")))


def _hinted(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(HINTS))


def identifiers(text: Column) -> Column:
    """The text as its sequence: `<number>` for a known sentence, OTHER for anything else."""
    by_line = lambda s: F.array_join(F.transform(F.split(s, LINE_END), lambda x: F.coalesce(_identifier(x), F.lit(OTHER))), "")
    one = lambda s: F.when(_hinted(s), F.coalesce(_identifier(s), by_line(s))).otherwise(F.lit(OTHER))
    found = F.array_join(F.transform(F.split(text, SENTENCE_END), one), "")
    return F.when(_hinted(text), found).otherwise(F.lit(OTHER))


def recognised(docs: DataFrame) -> DataFrame:
    """docs without the text, with `licences` (names in the order of the rules, once each) and `n_matches`.

    Null and empty texts, and those without a known sentence, have no licence. Repeated rows get equal results. Of the
    other columns, those with the two names, or `identifiers`, are replaced.
    """
    docs = docs.drop("licences", "n_matches", "identifiers")
    kept = [c for c in docs.columns if c != "text"]
    rules = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(sequence(ids)).alias("ids")) for name, ids in RULES])
    names = F.array().cast("array<string>")
    begin = lambda s: F.struct(s.alias("left"), names.alias("licences"), F.lit(0).cast("long").alias("n"))

    def match(state: Column, rule: Column) -> Column:
        rest = F.replace(state["left"], rule["ids"], F.lit(OTHER))
        # A match leaves one character in place of the rule's.
        taken = (F.length(state["left"]) - F.length(rest)) / (F.length(rule["ids"]) - 1)
        found = F.when(taken > 0, F.array_union(state["licences"], F.array(rule["licence"]))).otherwise(state["licences"])
        return F.struct(rest.alias("left"), found.alias("licences"), (state["n"] + taken.cast("long")).alias("n"))

    ids = docs.select(*kept, identifiers(F.coalesce(docs["text"], F.lit(""))).alias("identifiers"))
    state = F.when(F.col("identifiers").contains("<"), F.aggregate(rules, begin(F.col("identifiers")), match)).otherwise(begin(F.col("identifiers")))
    return ids.withColumn("_state", state).select(*kept, "identifiers", F.col("_state.licences").alias("licences"), F.col("_state.n").alias("n_matches"))


def oracle_sql() -> str:
    """DuckDB statement for (doc_id, licences joined by `,`, n_matches) of documents."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = "[" + ", ".join(map(text, SENTENCES.values())) + "]"
    hint = text("(?i)" + "|".join(HINTS))
    normal = lambda s: f"trim(regexp_replace(translate({s}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    number = lambda s: f"'<' || nullif(list_position({known}, {normal(s)}), 0) || '>'"
    lines = f"array_to_string([coalesce({number('y')}, '{OTHER}') FOR y IN string_split_regex(x, {text(LINE_END)})], '')"
    one = f"CASE WHEN regexp_matches(x, {hint}) THEN coalesce({number('x')}, {lines}) ELSE '{OTHER}' END"
    steps = [
        f"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), {hint}) THEN array_to_string([{one} FOR x IN "
        f"string_split_regex(coalesce(text, ''), {text(SENTENCE_END)})], '') ELSE '{OTHER}' END AS s0 FROM documents"
    ]
    columns, counts = [], []
    for i, (_, ids) in enumerate(RULES):
        own = sequence(ids)
        columns.append(f"replace(s{i}, '{own}', '{OTHER}') AS s{i + 1}, CAST((length(s{i}) - length(s{i + 1})) / {len(own) - 1} AS BIGINT) AS c{i}")
        counts.append(f"c{i}")
    steps.append(f"SELECT *, {', '.join(columns)} FROM ids")
    by_name: dict[str, list[str]] = {}
    for (name, _), c in zip(RULES, counts, strict=True):
        by_name.setdefault(name, []).append(c)
    # Names come in the order of the first rule that matches.
    first = [f"struct_pack(at := least({', '.join(f'CASE WHEN {c} > 0 THEN {c[1:]} ELSE 999 END' for c in cs)}, 999), name := {text(n)})" for n, cs in by_name.items()]
    names = f"array_to_string([z.name FOR z IN list_sort([{', '.join(first)}]) IF z.at < 999], ',')"
    return f"WITH ids AS ({steps[0]}), matched AS ({steps[1]}) SELECT doc_id, {names} AS licences, CAST({' + '.join(counts)} AS BIGINT) AS n_matches FROM matched"

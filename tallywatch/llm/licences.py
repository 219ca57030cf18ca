"""Licence recognition by sentences.

Text is cut into sentences, over line breaks, and normalised; known sentences
become identifiers, one for each pattern they match; the sequence of a document's identifiers is matched against licence rules in
their order, and what a rule has used is gone for the rules behind it. One
pass, no shuffle, built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A pattern over the normalised sentence per identifier. The last counts only where no other matches.
SENTENCES = [
    ("MITGrant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included"),
    ("ISCGrant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("BSDGrant", r"redistribution and use in source and binary forms with or without modification"),
    ("BSDSource", r"redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDEndorse", r"neither the name of .* nor the names of its contributors may be used"),
    ("AsIs", r"(software|work|program) is provided (by the copyright holders and contributors )?as is"),
    ("Liability", r"in no event (shall|will) the .*(authors|copyright (holders?|owner)|contributors).* be liable"),
    ("GPLFree", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("GPLVersion3", r"gnu general public license .*version 3"),
    ("GPLVersion2", r"gnu general public license .*version 2"),
    ("LGPLRef", r"gnu (lesser|library) general public license"),
    ("AGPLRef", r"gnu affero general public license"),
    ("ApacheRef2", r"(licensed|released|distributed) under the apache license version 2\.0"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("MITRef", r"(licensed|released|distributed) under the mit license"),
    ("BSDRef", r"(licensed|released|distributed) under the .*bsd .*license"),
    ("MPLRef2", r"mozilla public license .*(version |v )?2\.0"),
    ("CCByNcSa4", r"(licensed|released|distributed) under (a )?(cc|creative commons) by nc sa 4\.0"),
    ("CCByNc4", r"(licensed|released|distributed) under (a )?(cc|creative commons) by nc 4\.0"),
    ("CCBySa4", r"(licensed|released|distributed) under (a )?(cc|creative commons) by sa 4\.0"),
    ("CCBy4", r"(licensed|released|distributed) under (a )?(cc|creative commons) by 4\.0"),
    ("SPDXMIT", r"spdx license identifier mit$"),
    ("SPDXApache2", r"spdx license identifier apache 2\.0$"),
    ("Reserved", r"all rights reserved"),
    ("Copyright", r"^(copyright|c) .*[0-9]{4}"),
    ("UnknownLicence", r"(licensed|released|distributed) under .*licen[cs]e"),
]
# Licence and the identifiers that make it, in the order of matching.
RULES = [
    ("MIT", "MITGrant MITNotice AsIs Liability"),
    ("MIT", "MITGrant MITNotice AsIs"),
    ("BSD-3-Clause", "BSDGrant BSDSource BSDBinary BSDEndorse AsIs Liability"),
    ("BSD-3-Clause", "BSDGrant BSDSource BSDBinary BSDEndorse AsIs"),
    ("BSD-2-Clause", "BSDGrant BSDSource BSDBinary AsIs Liability"),
    ("BSD-2-Clause", "BSDGrant BSDSource BSDBinary AsIs"),
    ("ISC", "ISCGrant AsIs Liability"),
    ("ISC", "ISCGrant AsIs"),
    ("Apache-2.0", "ApacheRef2 ApacheObtain"),
    ("Apache-2.0", "ApacheRef2"),
    ("Apache-2.0", "SPDXApache2"),
    ("MIT", "MITRef"),
    ("MIT", "SPDXMIT"),
    ("GPL-3.0", "GPLFree GPLVersion3"),
    ("GPL-3.0", "GPLVersion3"),
    ("GPL-2.0", "GPLFree GPLVersion2"),
    ("GPL-2.0", "GPLVersion2"),
    ("GPL", "GPLFree"),
    ("LGPL", "LGPLRef"),
    ("AGPL", "AGPLRef"),
    ("BSD", "BSDRef"),
    ("MPL-2.0", "MPLRef2"),
    ("CC-BY-NC-SA-4.0", "CCByNcSa4"),
    ("CC-BY-NC-4.0", "CCByNc4"),
    ("CC-BY-SA-4.0", "CCBySa4"),
    ("CC-BY-4.0", "CCBy4"),
    ("Proprietary", "Copyright Reserved"),
    ("Unknown", "UnknownLicence"),
]
KEYWORDS = r"licen[cs]e|copyright|permission|redistribution|provided|warrant|in no event|rights reserved|creative commons|spdx"

# the same where a line break or a comment mark parts the words
_HINT = KEYWORDS.replace(" ", r"[^\p{L}\p{N}]+")
# lines that are sentences of their own, whatever stands around them
_OWN_LINE = r"(?m)^([^\p{L}\p{N}\r\n]*(?:(?:copyright|\(c\)|c |©)[^\r\n]*[0-9]{4}|spdx.license.identifier)[^\r\n]*)$"
_WORD_MARKS = r"(?m)^[ \t]*(?:dnl|rem)[ \t]+"
# full stops, and lines without a letter or digit
_ENDS = r"[.!?]+\s+|[\r\n]+[^\p{L}\p{N}\r\n]*[\r\n]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(docs: DataFrame) -> DataFrame:
    """Add ``sentence_ids`` and ``licences`` (arrays in text order, and in rule order) to every row.

    Sentences end at a full stop before white space and at lines without letter
    or digit; copyright lines with a year and SPDX lines stand alone. Other line
    breaks are blanks. Signs other than letters, digits and full stops inside
    words are dropped before comparison, so comment marks and decoration do not
    matter. A sentence has an identifier for each pattern in it, in the order of
    their places. Text of any
    length is read whole; null or empty text has no sentences; repeated rows are
    scanned alike; other columns stay as they are, but for two of these names.
    """
    kept = [c for c in docs.columns if c not in ("sentence_ids", "licences")]
    known = ", ".join(f"named_struct('at', regexp_instr(x, {_quoted(p)}), 'k', {k}, 'id', '{i}')" for k, (i, p) in enumerate(SENTENCES))
    clean = r"trim(regexp_replace(regexp_replace(x, '[^\\p{L}\\p{N}.]+', ' '), '[. ]+$', ''))"
    folded = f"regexp_replace(regexp_replace(replace(lower(text), '\\r\\n', '\\n'), {_quoted(_WORD_MARKS)}, ''), {_quoted(_OWN_LINE)}, '\\n\\n$1\\n\\n')"
    sentences = f"""filter(transform(filter(split({folded}, {_quoted(_ENDS)}), x -> x RLIKE {_quoted(_HINT)}),
        x -> {clean}), x -> x != '')"""
    matches = f"transform(array_sort(filter(array({known}), s -> s.at > 0)), s -> s.id)"
    last = SENTENCES[-1][0]
    found = docs.withColumn(
        "sentence_ids",
        F.expr(f"""CASE WHEN lower(text) RLIKE {_quoted(_HINT)}
            THEN flatten(transform(transform({sentences}, x -> {matches}), i -> IF(size(i) > 1, array_remove(i, '{last}'), i)))
            ELSE CAST(array() AS array<string>) END"""),
    )
    # the sequence as a text with one space on either side of each identifier
    state = "named_struct('rest', concat(' ', array_join(sentence_ids, '  '), ' '), 'found', CAST(array() AS array<string>))"
    rules = ", ".join(f"named_struct('name', {_quoted(n)}, 'ids', ' {'  '.join(i.split())} ')" for n, i in RULES)
    step = """named_struct(
        'rest', replace(s.rest, r.ids, ' . '),
        'found', IF(contains(s.rest, r.ids), array_union(s.found, array(r.name)), s.found))"""
    matched = f"CASE WHEN size(sentence_ids) > 0 THEN aggregate(array({rules}), {state}, (s, r) -> {step}).found ELSE CAST(array() AS array<string>) END"
    return found.withColumn("licences", F.expr(matched)).select(*kept, "sentence_ids", "licences")

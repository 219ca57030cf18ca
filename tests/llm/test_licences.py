from tallywatch.llm import licences as L
from text_fixtures import docs_of  # noqa: F401 (a fixture)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software.
# The above copyright notice and this permission notice shall be included in all copies.
* THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE."""


def found(spark, docs_of, *texts):
    rows = L.scan(docs_of(list(texts)).withColumnRenamed("gram", "licences")).orderBy("doc_id").collect()
    return [r["licences"] for r in rows], [r["sentence_ids"] for r in rows]


def test_rules_in_order(spark, docs_of):
    licences, ids = found(
        spark, docs_of, MIT, "x\nReleased under the MIT License.\ny", "RELEASED&& UNDER&& THE&& MIT&& LICENSE.",
        "Licensed under the Apache License, Version 2.0. You may obtain a copy of the License at", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", None, "", "the warranty of life", "Released under the Foo License.",
        "Copyright (c) 2020 A. Person\nAll rights reserved.", "Released under the MIT License.\n" * 3,
        "Released under the MIT License.\nLicensed under CC BY-NC 4.0.",
    )
    assert licences == [["MIT"], ["MIT"], ["MIT"], ["Apache-2.0"], ["CC-BY-NC-4.0"], ["GPL-3.0"], [], [], [], ["Unknown"], ["Proprietary"], ["MIT"], ["MIT", "CC-BY-NC-4.0"]]
    assert ids[0] == ["MITGrant", "MITNotice", "AsIs", "Liability"] and ids[11] == ["MITRef"] * 3


def test_order_matters_and_long_texts(spark, docs_of):
    lines = MIT.split("\n")
    licences, _ = found(spark, docs_of, "\n".join(lines[::-1]), "word " * 200_000 + "\n" + MIT)
    assert licences == [[], ["MIT"]]
    assert L.scan(docs_of([])).count() == 0


BSD = """Copyright (c) 2020, A. Person

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice, this list of conditions and the following disclaimer in the documentation.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from it.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES."""
WRAPPED_MIT = """Permission is hereby granted, free of charge, to any person
obtaining a copy of this software, to deal in it.

The above copyright notice and this permission notice shall be
included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Licensed under the Apache License,
Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the
License at

    http://www.apache.org/licenses/LICENSE-2.0"""


def test_sentences_over_line_breaks(spark, docs_of):
    texts = [BSD, GPL, ISC, WRAPPED_MIT, APACHE]
    for mark in ("", " * ", "# ", "// ", "dnl "):
        for end in ("\n", "\r\n"):
            licences, ids = found(spark, docs_of, *(end.join((mark + line).rstrip() for line in t.split("\n")) for t in texts))
            assert licences == [["BSD-3-Clause"], ["GPL-3.0"], ["ISC"], ["MIT"], ["Apache-2.0"]], (mark, end)
            assert ids[0] == ["Copyright", "BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "AsIs", "Liability"]
            assert ids[1] == ["GPLFree", "GPLVersion3"] and ids[3][-1] == "Liability" and ids[4] == ["ApacheRef2", "ApacheObtain"]


def test_lines_that_stand_alone(spark, docs_of):
    licences, ids = found(spark, docs_of, "code\n// SPDX-License-Identifier: MIT\nmore code", "# Copyright 2020 A\n# All rights reserved", "distributed under creative\ncommons by 4.0")
    assert licences == [["MIT"], ["Proprietary"], ["CC-BY-4.0"]]

"""Each known licence sentence alone, wrapped, and in comment blocks."""

import textwrap

import pytest

from vestigia.llm import licenses

MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or (at your
option) any later version.

This program is distributed in the hope that it will be useful, but
WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
General Public License for more details."""


def block(lines, style):
    first, each, last = {"plain": ("", "", ""), "c": ("/*\n", " * ", "\n */\nint x;"), "hash": ("", "# ", "\nimport os"),
                         "slash": ("", "// ", "\npackage main"), "box": ("/***\n", " * ", "\n ***/\n"), "crlf": ("", "", "\r\nMore")}[style]
    joined = "\n".join((each + line + ("     *" if style == "box" else "")).rstrip() for line in lines)
    return first + (joined.replace("\n", "\r\n") if style == "crlf" else joined) + last


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.sentence_ids, r.licenses) for r in licenses.recognised(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("style", ["plain", "c", "hash", "slash", "box", "crlf"])
def test_each_sentence_alone_and_wrapped(spark, style):
    wrap = lambda s, n: textwrap.wrap(s, n, break_long_words=False, break_on_hyphens=False)
    shapes = [lambda s: [s], lambda s: wrap(s, 60), lambda s: wrap(s, 25), lambda s: ["Some words.", *wrap(s, 40), "", "Next"]]
    cases = [(i, block(shape(s + end), style)) for i, s in licenses.SENTENCES for end in ("", ".") for shape in shapes]
    assert [ids for ids, _ in found(spark, [t for _, t in cases])] == [[i] for i, _ in cases]


@pytest.mark.parametrize("style", ["plain", "c", "hash", "slash", "box", "crlf"])
def test_notices_of_source_headers(spark, style):
    texts = [block(t.split("\n"), style) for t in (MPL, APACHE, GPL)]
    assert found(spark, texts) == [
        (["MplRef"], ["MPL-2.0"]), (["ApacheRefComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"], ["Apache-2.0"]),
        (["Gpl2Plus", "GplUseful", "GplSee"], ["GPL-2.0-or-later"])]


def test_parts_of_other_sentences_are_not_found(spark):
    texts = ["Licensed under the GNU General Public License, version 2\nor any later version", "# Licensed under the MIT License\n# or another one",
             "It is not licensed under the MIT License.", "Licensed under the MIT. License", "Released under the MIT License of 1999"]
    assert found(spark, texts) == [([], [])] * len(texts)

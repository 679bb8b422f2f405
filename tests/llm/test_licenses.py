"""Standard licence texts, wrapped, on one line, in comments and under headings."""

import textwrap

import duckdb
import pytest
from emberline.llm import licenses, queries

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice in the documentation.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
]
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
wrap = lambda x, n=72, p="": textwrap.fill(x, n, initial_indent=p, subsequent_indent=p)
CASES = [
    (MIT, "10", "MIT"),
    ("MIT License\nCopyright (c) 2020 A. Person\n" + wrap(MIT), "10", "MIT"),
    (wrap(APACHE), "2,3", "Apache-2.0"),
    (APACHE, "2,3", "Apache-2.0"),
    ("/*\n" + wrap(APACHE, 60, " * ") + "\n */\nint main;", "2,3", "Apache-2.0"),
    ("\n\n".join(map(wrap, BSD)), "7,8", "BSD-3-Clause"),
    ("\n".join(wrap(x, 50, "# ") for x in BSD), "7,8", "BSD-3-Clause"),
    ("\n\n".join(map(wrap, BSD[:3])), "7", "BSD-2-Clause"),
    (wrap(GPL), "12", "GPL-3.0"),
    ("          GNU GENERAL PUBLIC LICENSE\r\n     Version 3, 29 June 2007\r\n", "13", "GPL-3.0"),
    ("a line\nReleased under the MIT License\nReleased under the\nMIT License\nanother line", "1,1", "MIT"),
    ("Licensed under\n\nthe MIT License. We released under the MIT License today.", "", None),
    ("Licensed under. The MIT License", "", None),
]


@pytest.fixture(scope="module")
def rows():
    return [(i, x) for i, (x, _, _) in enumerate(CASES)] + [(99, None)]


def test_standard_texts(spark, rows):
    got = {r.doc_id: (r.sentence_ids, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (ids, name) for i, (_, ids, name) in enumerate(CASES)} | {99: ("", None)}


def test_standard_texts_in_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = {r[0]: (r[1], r[3]) for r in con.execute(queries.OP5_SQL).fetchall()}
    assert got == {i: (ids, name) for i, (_, ids, name) in enumerate(CASES)} | {99: ("", None)}

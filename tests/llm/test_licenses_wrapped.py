from __future__ import annotations

import re

from tallyspark.llm import licenses, queries

MIT = """MIT License

Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
APACHE = """Copyright 2020 A. Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
BSD = """Copyright (c) 2020, A. Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.
"""
CASES = [
    (MIT, ",0,2,3,0,", "MIT"), (APACHE, ",0,5,6,0,", "Apache-2.0"), (BSD, ",0,20,14,15,16,17,0,", "BSD-3-Clause"), (GPL, ",8,", "GPL-3.0-or-later"), (MPL, ",18,0,", "MPL-2.0"),
    ("".join(f"# {x}".rstrip() + "\n" for x in APACHE.splitlines()), ",0,5,6,0,", "Apache-2.0"), (MIT.replace("\n", "\r\n"), ",0,2,3,0,", "MIT"),
    (re.sub(r"\n\n(?=\d\.)", "\n", BSD), ",0,20,14,15,16,17,0,", "BSD-3-Clause"), (re.sub(r"(\d)\. ", r"(\1) ", BSD), ",0,20,14,15,16,17,0,", "BSD-3-Clause"),
    ("Some words\nLicensed under CC BY 4.0\nand others", ",0,10,0,", "CC-BY-4.0"), ("Released\nunder the MIT License", ",1,", "MIT"), ("Released\n\nunder the MIT License", ",0,", None),
    ("We released\nunder the MIT License", ",0,", None), ("This work is licensed under the GNU General Public License version\n3. More.", ",7,0,", "GPL-3.0"), ("", ",,", None), (None, ",,", None),
]


def test_texts_as_published(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: (r.sequence, r.license) for r in licenses.scan_licenses(docs, wrapped=True).collect()}
    assert got == {i: (s, n) for i, (_, s, n) in enumerate(CASES)}


def test_no_notice_is_lost(spark):
    path = "/root/testdata/sf0.001"
    plain, wrapped = ({r.doc_id: r.license for r in queries.QUERIES[q](spark, path).collect()} for q in ("op5_license_scan", "op5_license_scan_wrapped"))
    assert any(plain.values()) and all(wrapped[i] == name for i, name in plain.items() if name)


def test_no_user_functions(docs):
    plan = licenses.scan_licenses(docs, wrapped=True)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan

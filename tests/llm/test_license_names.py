"""Public headers and licence files come to their own licences, sisters kept apart."""

from gradeloom.llm.license_scan import TEMPLATES, scan_licenses

GNU = "as published by the Free Software Foundation"
HOPE = "in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."


def gnu(what, name, version, sep=":"):
    mark = "," if sep == ":" else ";"
    return f"# This {what} is free software{sep} you can redistribute it and/or modify\n# it under the terms of the {name} {GNU}{mark}\n# either version {version} of the License, or (at your option) any later version.\nimport os\n"


BSD = [t for t in TEMPLATES["BSD-2-Clause"] if "1. Redistributions" in t][0]
BSD3 = [t for t in TEMPLATES["BSD-3-Clause"] if "3. Neither" in t][0]
CASES = [
    ("GPL-3.0", "a.py", gnu("program", "GNU General Public License", 3)),
    ("GPL-2.0", "a.c", gnu("program", "GNU General Public License", 2, ";")),
    ("LGPL-3.0", "b.py", gnu("library", "GNU Lesser General Public License", 3)),
    ("LGPL-2.1", "c.py", gnu("library", "GNU Lesser General Public License", 2.1, ";")),
    ("AGPL-3.0", "d.py", gnu("program", "GNU Affero General Public License", 3)),
    ("GPL-3.0", "e.py", gnu("program", "GNU General Public License", 3).replace("import os\n", f"#\n# This program is distributed {HOPE} See the\n# GNU General Public License for more details.\nimport os\n")),
    ("AGPL-3.0", "f.py", gnu("program", "GNU Affero General Public License", 3).replace("import os\n", f"#\n# This program is distributed {HOPE} See the\n# GNU Affero General Public License for more details.\nimport os\n")),
    ("BSD-2-Clause", "LICENSE", "BSD 2-Clause License\n\nCopyright (c) 2020, Some One\n\n" + BSD),
    ("BSD-3-Clause", "LICENSE", "BSD 3-Clause License\n\nCopyright (c) 2020, Some One\n\n" + BSD3),
    ("BSD-3-Clause", "g.go", "// Copyright 2009 The Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\npackage main\n"),
    ("MIT", "LICENSE.txt", "MIT License\n\nCopyright (c) 2021 Some One\n\n" + TEMPLATES["MIT"][1]),
    ("MIT", "h.js", "/* SPDX-License-Identifier: MIT */\nlet a = 1;\n"),
    ("Apache-2.0", "i.rs", "// SPDX-License-Identifier: Apache-2.0\nfn main() {}\n"),
    ("GPL-2.0", "j.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint a;\n"),
    ("GPL-3.0", "k.py", "# SPDX-License-Identifier: GPL-3.0-only\nx = 1\n"),
    ("Apache-2.0", "l.java", "/*\n * " + TEMPLATES["Apache-2.0"][1].replace(". ", ".\n * ") + "\n */\nclass A {}\n"),
    ("MPL-2.0", "m.cpp", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\nint b;\n"),
    ("ISC", "LICENSE.md", "Copyright (c) 2019 Some One\n\n" + TEMPLATES["ISC"][0]),
    ("Unlicense", "UNLICENSE", TEMPLATES["Unlicense"][0]),
    ("Zlib", "LICENSE-zlib", TEMPLATES["Zlib"][0]),
    ("EPL-2.0", "n.java", "/*\n * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n */\nclass B {}\n"),
    ("BSL-1.0", "o.hpp", "// Distributed under the Boost Software License, Version 1.0. (See\n// accompanying file LICENSE_1_0.txt or copy at\n// http://www.boost.org/LICENSE_1_0.txt)\nint c;\n"),
    ("CC-BY-4.0", "p.md", "This work is licensed under a Creative Commons Attribution 4.0\nInternational License.\n"),
    ("CC-BY-SA-4.0", "q.md", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.\n"),
    (None, "r.py", "print('a licence to kill is a film of 1989 and no licence of this file at all, they said while walking home')\n"),
    (None, "s.txt", "SPDX-License-Identifier: NoSuchLicence-9\n"),
]


def test_public_headers_and_files(spark):
    rows = [(k, f"p{k}/{name}", text) for k, (_, name, text) in enumerate(CASES)]
    found = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [(k, found[k], want) for k, (want, _, _) in enumerate(CASES) if found[k] != want] == []

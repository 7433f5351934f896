"""Licence notices and short licence texts, as published. Fixed values. ``every`` adds full texts (files in ``licences``), standard headers and usual notices."""

from __future__ import annotations

import os
import re

TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "rights-reserved": "All rights reserved.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If
not, see <https://www.gnu.org/licenses/>.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not
be removed or altered from any source distribution.""",
}

#: What redistribution clauses of BSD-3-Clause have between those of BSD-2-Clause and the disclaimer.
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission. THIS SOFTWARE IS PROVIDED"""

_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by
the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that
it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not,
see <https://www.gnu.org/licenses/>."""

HEADERS = {
    "bsd-3-clause": TEMPLATES["bsd-2-clause"].replace("THIS SOFTWARE IS PROVIDED", _BSD_3, 1),
    "gpl-2.0-or-later": _GNU.format("", "2"),
    "lgpl-2.1-or-later": _GNU.format("Lesser ", "2.1"),
    "lgpl-3.0-or-later": _GNU.format("Lesser ", "3"),
    "agpl-3.0-or-later": _GNU.format("Affero ", "3"),
    "epl-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
}

#: Names that notices use.
NAMES = {
    "mit": ("the MIT License",),
    "isc": ("the ISC License",),
    "apache-2.0": ("the Apache License 2.0", "the Apache License, Version 2.0"),
    "bsd-2-clause": ("the BSD 2-Clause License",),
    "bsd-3-clause": ("the BSD 3-Clause License",),
    "mpl-1.1": ("the Mozilla Public License 1.1", "the Mozilla Public License, version 1.1"),
    "mpl-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0"),
    "epl-1.0": ("the Eclipse Public License 1.0", "the Eclipse Public License, version 1.0"),
    "epl-2.0": ("the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"),
    "cc0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    **{
        f"{k}-{v}.0": (f"the GNU {n}General Public License v{v}.0", f"the GNU {n}General Public License, version {v}")
        for k, n, versions in (("gpl", "", "123"), ("lgpl", "Lesser ", "3"), ("agpl", "Affero ", "3")) for v in versions
    },
    "lgpl-2.1": ("the GNU Lesser General Public License v2.1", "the GNU Lesser General Public License, version 2.1"),
    **{
        f"cc-{k}-{v}": (f"CC {k.upper()} {v}", f"a Creative Commons {n} {v} {'International' if v == '4.0' else 'Unported'} License")
        for v in ("3.0", "4.0")
        for k, n in (
            ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc", "Attribution-NonCommercial"),
            ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
NOTICES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under the terms of {}.")


def _plain(text: str) -> str:
    return " ".join(re.findall("[a-z0-9]+", text.lower()))


def every() -> dict[str, str]:
    """All templates; a notice that TEMPLATES have under another name keeps that name. Read where the plan is made, workers get the library."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licences")
    out = TEMPLATES | HEADERS
    for name in sorted(os.listdir(folder)):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out[name.removesuffix(".txt").lower() + "-text"] = f.read()
    known = {_plain(t) for t in out.values()}
    for name, ways in NAMES.items():
        for k, (notice, way) in enumerate((n, w) for w in ways for n in NOTICES):
            if _plain(text := notice.format(way)) not in known:
                out[f"{name}-notice-{k}"] = text
    return out

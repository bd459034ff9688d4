"""The license texts that ``op10_license_scan`` looks for: (license, text), several wordings a license.

Whole texts are files of ``licenses/``, named after the license. Notices, headers and short
licenses stand here. The whole texts of the AGPL and of the Creative Commons licenses other than
CC0 are not included; their headers and notices are. Headers of the GNU licenses come twice: the
notice as a whole under every version, as versions differ in a word, and the words that
tell kind and version apart, in which 4 of 19 shingles are lost with another kind or version.
"""

from __future__ import annotations

from pathlib import Path

from heedstream.llm.license_scan import TEMPLATES

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

NOTICES = [
    ("MIT", _MIT + _AS_IS),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Licensed under the MIT license."),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + "3. " + _BSD3 + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD3),
    ("BSD", _BSD_AS_IS),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
]

#: GNU licenses: kind, name in the text, what is licensed, versions.
_GNU = [("GPL", "GNU General Public License", "program", ("2", "3")), ("LGPL", "GNU Lesser General Public License", "library", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", "program", ("3",))]
for _kind, _name, _what, _versions in _GNU:
    for _v in _versions:
        _id = f"{_kind}-{_v}" + ("" if "." in _v else ".0")
        for _x in dict.fromkeys((_what, "program")):
            NOTICES.append((_kind, f"This {_x} is free software: you can redistribute it and/or modify it under the terms of the {_name} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version. This {_x} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {_name} for more details. You should have received a copy of the {_name} along with this {_x}."))
        NOTICES.append((_id, f"under the terms of the {_name} as published by the Free Software Foundation, either version {_v} of the License, or"))
        NOTICES.append((_id, f"under the terms of the {_name} version {_v} as published by the Free Software Foundation"))

#: Creative Commons: id, name, short name, versions.
_CC = [("CC-BY", "Attribution", "by"), ("CC-BY-SA", "Attribution-ShareAlike", "by-sa"), ("CC-BY-NC", "Attribution-NonCommercial", "by-nc"), ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "by-nc-sa"), ("CC-BY-ND", "Attribution-NoDerivatives", "by-nd"), ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "by-nc-nd")]
for _id, _name, _short in _CC:
    NOTICES += [
        (f"{_id}-4.0", f"licensed under a Creative Commons {_name} 4.0 International License"),
        (f"{_id}-4.0", f"Creative Commons {_name} 4.0 International"),
        (f"{_id}-4.0", f"Licensed under {_id.replace('CC-', 'CC ')} 4.0."),
        (f"{_id}-4.0", f"creativecommons.org/licenses/{_short}/4.0"),
        (f"{_id}-3.0", f"licensed under a Creative Commons {_name} 3.0 Unported License"),
        (f"{_id}-3.0", f"creativecommons.org/licenses/{_short}/3.0"),
    ]
NOTICES.append(("CC0-1.0", "creativecommons.org/publicdomain/zero/1.0"))

_SPDX = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib", *(f"{i}-4.0" for i, _, _ in _CC)]
NOTICES += [(i, f"SPDX-License-Identifier: {i}") for i in _SPDX]


def table() -> list[tuple[str, str]]:
    """All (license, text): whole texts, notices, and the short notices of the scan itself."""
    whole = [(p.stem, p.read_text(encoding="utf-8", errors="replace")) for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))]
    return list(dict.fromkeys([*TEMPLATES, *NOTICES, *whole]))

"""The notices and licence texts that files are compared with."""

from __future__ import annotations

# Public licence identifiers, names, versions, notices and short texts.
GNU = (
    ("GPL", "GNU General Public License", (("1.0", "February 1989"), ("2.0", "June 1991"), ("3.0", "29 June 2007"))),
    ("LGPL", "GNU Lesser General Public License", (("2.1", "February 1999"), ("3.0", "29 June 2007"))),
    ("LGPL", "GNU Library General Public License", (("2.0", "June 1991"),)),
    ("AGPL", "GNU Affero General Public License", (("3.0", "19 November 2007"),)),
)
CREATIVE_COMMONS = (
    ("BY", "Attribution"),
    ("BY-SA", "Attribution-ShareAlike"),
    ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC", "Attribution-NonCommercial"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
)
CC_VERSIONS = (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))
NAMED = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-1.1", "Apache License, Version 1.1"),
    ("MIT", "MIT License"),
    ("MIT-0", "MIT No Attribution License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("MPL-1.1", "Mozilla Public License, version 1.1"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("EPL-1.0", "Eclipse Public License, version 1.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Zlib", "zlib License"),
    ("Unlicense", "Unlicense"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_GRANT_ALONE = _GRANT.replace(", subject to the following conditions:", ".")
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES '
    "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEXTS = (
    ("MIT", _GRANT),
    ("MIT", f"{_GRANT} {_NOTICE}"),
    ("MIT", f"MIT License {_GRANT} {_NOTICE} {_AS_IS}"),
    ("MIT", "Released under the MIT License."),
    ("MIT-0", f"{_GRANT_ALONE}"),
    ("MIT-0", f"MIT No Attribution {_GRANT_ALONE} {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_TWO}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_TWO} {_BSD_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} {_BSD_THREE}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} {_BSD_THREE} {_BSD_AS_IS}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}"),
    ("0BSD", f"{_ISC}."),
    ("0BSD", f"{_ISC}. {_ISC_AS_IS}"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
)

#: Words of a family of which a text and the template that it is given must have the same ones.
MARKS = (
    ("GPL LGPL AGPL", "lesser library affero lgpl agpl"),
    ("CC", "noncommercial sharealike noderivatives noderivs nc sa nd cc0 universal"),
    ("BSD-2-Clause BSD-3-Clause", "endorse neither"),
    ("ISC 0BSD", "appear provided"),
    ("MIT", "conditions"),
)


def _families() -> list[tuple[str, str]]:
    """(identifier, text) of the families whose notices follow a rule."""
    out = []
    for short, name, versions in GNU:
        for v, date in versions:
            said, licence = v.removesuffix(".0"), f"{short}-{v}"
            out += [
                (licence, f"This work is licensed under the {name}, version {said}."),
                (licence, f"Licensed under the {name}, version {said}."),
                (licence, f"{name} Version {said}, {date}"),
                (licence, f"{name} Version {said} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
            ]
            for thing in ("program", "library"):
                terms = f"is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {said} of the License"
                tail = f"WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
                out += [
                    (licence, f"This {thing} {terms}"),
                    (licence, f"This {thing} {terms}, or (at your option) any later version."),
                    (licence, f"This {thing} {terms}, or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but {tail}"),
                    (licence, f"This {thing} {terms}, or (at your option) any later version. This {thing} is distributed in the hope that it will be useful, but {tail} You should have received a copy of the {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."),
                ]
            out += [(licence, f"SPDX-License-Identifier: {licence}{x}") for x in ("", "-only", "-or-later")]
    for short, name in CREATIVE_COMMONS:
        for v, where in CC_VERSIONS:
            licence = f"CC-{short}-{v}"
            out += [
                (licence, f"Licensed under CC {short} {v}."),
                (licence, f"This work is licensed under a Creative Commons {name} {v} {where} License."),
                (licence, f"Creative Commons {name} {v} {where} Public License"),
                (licence, f"SPDX-License-Identifier: {licence}"),
            ]
    for licence, name in NAMED:
        out += [
            (licence, f"Licensed under the {name}."),
            (licence, f"Licensed under the {name}. See LICENSE file in the project root for full license information."),
            (licence, f"License: {licence}"),
            (licence, f"SPDX-License-Identifier: {licence}"),
        ]
    out.append(("0BSD", "SPDX-License-Identifier: 0BSD"))
    return out


TEMPLATES = (*TEXTS, *_families())

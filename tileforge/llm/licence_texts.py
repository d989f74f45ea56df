"""Headers, bodies, names and SPDX forms of usual licences, beside the notices of `licences.TEMPLATES`.

Wordings are compared as words, so punctuation and line breaks don't matter.
Of licences of more than some 300 words the title and opening stand for the body.
"""

from __future__ import annotations

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."


def _gnu(name: str, version: str, later: bool) -> str:
    """The header that the FSF asks for in source files."""
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {which}."


_CLASSES = {
    "0BSD": "permissive", "AGPL-3.0": "copyleft", "ARR": "proprietary", "Apache-2.0": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "BSL-1.0": "permissive",
    "CC-BY-4.0": "permissive", "CC-BY-NC-4.0": "noncommercial", "CC-BY-NC-ND-4.0": "noncommercial", "CC-BY-NC-SA-4.0": "noncommercial", "CC-BY-ND-4.0": "noderivatives", "CC-BY-SA-3.0": "copyleft", "CC-BY-SA-4.0": "copyleft",
    "CC0-1.0": "permissive", "EPL-2.0": "copyleft", "GFDL-1.3": "copyleft", "GPL-2.0": "copyleft", "GPL-3.0": "copyleft", "ISC": "permissive", "LGPL-2.1": "copyleft", "LGPL-3.0": "copyleft",
    "MIT": "permissive", "MIT-0": "permissive", "MPL-2.0": "copyleft", "Unlicense": "permissive", "WTFPL": "permissive", "Zlib": "permissive",
}

_BODIES = {
    "MIT": [_MIT],
    "MIT-0": [f"{_GRANT}. {_AS_IS}"],
    "BSD-2-Clause": [f"{_BSD} {_BSD_AS_IS}"],
    "BSD-3-Clause": [f"{_BSD} {_BSD_3} {_BSD_AS_IS}"],
    "ISC": [f"{_ISC}{_ISC_NOTICE} {_ISC_AS_IS}"],
    "0BSD": [f"{_ISC}. {_ISC_AS_IS}"],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "BSL-1.0": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"],
    "WTFPL": ["TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."],
}

_OPENINGS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."],
    "GPL-2.0": [f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"],
    "GPL-3.0": [f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"],
    "AGPL-3.0": [f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"],
    "LGPL-2.1": [f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}"],
    "LGPL-3.0": [f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"],
    "GFDL-1.3": [f"GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. <https://fsf.org/> {_VERBATIM}"],
    "MPL-2.0": ["Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."],
    "EPL-2.0": ["THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENTS ACCEPTANCE OF THIS AGREEMENT."],
}

_HEADERS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "GPL-2.0": [_gnu("General Public License", "2", True), _gnu("General Public License", "2", False)],
    "GPL-3.0": [_gnu("General Public License", "3", True), _gnu("General Public License", "3", False)],
    "AGPL-3.0": [_gnu("Affero General Public License", "3", True), _gnu("Affero General Public License", "3", False)],
    "LGPL-2.1": [_gnu("Lesser General Public License", "2.1", True), _gnu("Lesser General Public License", "2.1", False)],
    "LGPL-3.0": [_gnu("Lesser General Public License", "3", True), _gnu("Lesser General Public License", "3", False)],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
}

#: Each is found as a window of its own words.
_NAMES = {
    "0BSD": ["Zero-Clause BSD"],
    "AGPL-3.0": ["GNU AGPL v3", "AGPLv3 license", "AGPL-3.0", "GNU Affero General Public License v3.0", "GNU Affero General Public License version 3"],
    "ARR": ["All rights reserved."],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 License", "apache.org/licenses/LICENSE-2.0"],
    "BSD-2-Clause": ["BSD-2-Clause", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSL-1.0": ["Boost Software License", "BSL-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0", "creativecommons.org/licenses/by/4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-Non-Commercial 4.0", "creativecommons.org/licenses/by-nc/4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "creativecommons.org/licenses/by-nc-nd/4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "creativecommons.org/licenses/by-nc-sa/4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0", "creativecommons.org/licenses/by-nd/4.0"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0", "creativecommons.org/licenses/by-sa/3.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0", "creativecommons.org/licenses/by-sa/4.0"],
    "CC0-1.0": ["CC0 1.0", "creativecommons.org/publicdomain/zero/1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0"],
    "GFDL-1.3": ["GFDL-1.3", "GNU Free Documentation License"],
    "GPL-2.0": ["GNU GPL v2", "GPLv2 license", "GPL-2.0", "GNU General Public License v2.0", "GNU General Public License version 2", "GNU General Public License, version 2.0"],
    "GPL-3.0": ["GNU GPL v3", "GPLv3 license", "GPL-3.0", "GNU General Public License v3.0", "GNU General Public License version 3", "GNU General Public License, version 3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU LGPL v2.1", "LGPL-2.1", "GNU Lesser General Public License v2.1", "GNU Lesser General Public License version 2.1"],
    "LGPL-3.0": ["GNU LGPL v3", "LGPLv3 license", "LGPL-3.0", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License version 3"],
    "MIT": ["MIT License", "MIT licensed", "MIT licence", "opensource.org/licenses/MIT"],
    "MIT-0": ["MIT No Attribution", "identifier: MIT-0"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "MPL-2.0"],
    "Unlicense": ["The Unlicense", "unlicense.org"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License"],
}

#: SPDX identifiers of one word, whose tag is part of the bigram; longer ones are names.
_SPDX = {i: [f"Identifier: {i}"] for i in ("0BSD", "ISC", "MIT", "Unlicense", "WTFPL", "Zlib")}

WORDINGS = tuple((i, _CLASSES[i], wording) for part in (_BODIES, _OPENINGS, _HEADERS, _NAMES, _SPDX) for i, wordings in part.items() for wording in wordings)

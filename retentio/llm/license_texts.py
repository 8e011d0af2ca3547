"""Known licences of the scan, as fixed values: short texts, names that
notices use, digests of long texts. All are public licence texts.

Texts and names are canonicalised and digested when the table is made, so
they follow the canonical form; the digests of long texts were made with it
(the tests make them again from the texts where a system has them).
"""

from __future__ import annotations

from collections.abc import Iterator

# Short texts by SPDX identifier, without title and copyright line.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.

In jurisdictions that recognize copyright laws, the author or authors
of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit
of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of
relinquishment in perpetuity of all present and future rights to this
software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}

# Titles that stand above a text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "Expat License"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License"),
    "Unlicense": ("The Unlicense",),
}

# The standard header of the GNU licences.
GNU_HEADER = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the
GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your
option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
{name} for more details."""
GNU_ENDS = ("", """ You should have received a copy of the GNU {name} along with this {what}. If not, see
<http://www.gnu.org/licenses/>.""")
GNU = (("GPL-2.0-or-later", "General Public License", "2"), ("GPL-3.0-or-later", "General Public License", "3"),
       ("LGPL-2.1-or-later", "Lesser General Public License", "2.1"), ("LGPL-3.0-or-later", "Lesser General Public License", "3"),
       ("AGPL-3.0-or-later", "Affero General Public License", "3"))

# Names under which notices mention a licence.
NAMES = {
    "MIT": ("MIT", "MIT/X11", "Expat", "X11"),
    "MIT-0": ("MIT-0", "MIT No Attribution"),
    "ISC": ("ISC",),
    "0BSD": ("0BSD", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD 2-Clause", "2-Clause BSD", "Simplified BSD", "FreeBSD"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD 3-Clause", "3-Clause BSD", "New BSD", "Modified BSD", "Revised BSD"),
    "Zlib": ("zlib", "zlib/libpng"),
    "Unlicense": ("Unlicense",),
    "BSL-1.0": ("BSL-1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0",
                   "Apache License Version 2.0", "ASL 2.0"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0",
                "Mozilla Public License, v. 2.0", "Mozilla Public License v2.0"),
    "EPL-2.0": ("EPL-2.0", "EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"),
    "GPL-2.0": ("GPL-2.0", "GPLv2", "GPL v2", "GPL 2", "GPL version 2", "GNU GPL v2", "GNU GPL version 2", "GNU GPLv2",
                "GNU General Public License v2.0", "GNU General Public License version 2", "GNU General Public License, version 2"),
    "GPL-3.0": ("GPL-3.0", "GPLv3", "GPL v3", "GPL 3", "GPL version 3", "GNU GPL v3", "GNU GPL version 3", "GNU GPLv3",
                "GNU General Public License v3.0", "GNU General Public License version 3", "GNU General Public License, version 3"),
    "LGPL-2.1": ("LGPL-2.1", "LGPLv2.1", "LGPL v2.1", "LGPL 2.1", "GNU LGPL v2.1", "GNU Lesser General Public License v2.1",
                 "GNU Lesser General Public License, version 2.1"),
    "LGPL-3.0": ("LGPL-3.0", "LGPLv3", "LGPL v3", "LGPL 3", "GNU LGPL v3", "GNU Lesser General Public License v3.0",
                 "GNU Lesser General Public License, version 3"),
    "AGPL-3.0": ("AGPL-3.0", "AGPLv3", "AGPL v3", "GNU AGPL v3", "GNU Affero General Public License v3.0",
                 "GNU Affero General Public License, version 3"),
    "CC0-1.0": ("CC0-1.0", "CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    **{f"CC-{kind}-{v}": (f"CC-{kind}-{v}", f"CC {kind} {v}", f"Creative Commons {long} {v}", f"Creative Commons {long} {v} International"
                          if v == "4.0" else f"Creative Commons {long} {v} Unported")
       for v in ("3.0", "4.0") for kind, long in (
           ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
           ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
           ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "GFDL-1.3": ("GFDL-1.3", "GFDL 1.3", "GNU Free Documentation License, Version 1.3", "GNU Free Documentation License v1.3"),
}

# How a notice begins, the article, how it ends.
VERBS = ("Licensed", "Released", "Distributed", "Published", "Available", "Made available", "Provided", "Dual licensed")
SUBJECTS = ("This work", "This project", "This software", "This program", "This file", "This document", "The code")
PREDICATES = ("is licensed", "is released", "is distributed")
BEGINNINGS = (*(f"{v} under" for v in VERBS), *(f"{s} {p} under" for s in SUBJECTS for p in PREDICATES))
ARTICLES = ("", "the ", "the terms of the ")
ENDINGS = ("", " license")

# Digests of the canonical form of long public texts.
DIGESTS = {
    "Apache-2.0": "e32aea965561f41a8390221b29af2726",
    "Artistic-1.0-Perl": "a8b0fb0c6e43a3b36bdc159e59dbfd1e",
    "CC0-1.0": "93a180096f6cfcf2c0dd24f75c2eec48",
    "GFDL-1.2": "49ffacd2fea52c0c124f0d16bc990c74",
    "GFDL-1.3": "2d7ce083c264cf7f093acc742260e501",
    "GPL-1.0": "e5fd842fec56252356c4b59ff4c25396",
    "GPL-2.0": "c8178c7747e0c4dc179d321519588c40",
    "GPL-3.0": "3664953c6c5cb5b6ea0d5dad29801b48",
    "LGPL-2.0": "74cf7fcef3b29a39165a795b2cad3a3a",
    "LGPL-2.1": "f998bc436710cfece156aaa84fd26dd4",
    "LGPL-3.0": "b31b7335bc37919e8cdd79154e04d88d",
    "MPL-1.1": "1d22bb6758d83dd458139469fd04b57f",
    "MPL-2.0": "b5b7a0cf4994910cd0204fba4637d6ec",
}


def notices() -> Iterator[tuple[str, str]]:
    """(licence, notice): every beginning, article, name and ending."""
    for spdx, names in NAMES.items():
        yield spdx, f"SPDX-License-Identifier: {spdx}"
        for name in names:
            for ending in ENDINGS:
                for beginning in BEGINNINGS:
                    for article in ARTICLES:
                        yield spdx, f"{beginning} {article}{name}{ending}"


def texts() -> Iterator[tuple[str, str]]:
    """(licence, text): the short texts, with and without title, and headers."""
    for name, text in TEXTS.items():
        yield name, text
        for title in TITLES.get(name, ()):
            yield name, f"{title}\n\n{text}"
    for spdx, name, version in GNU:
        for what in ("program", "library", "file", "software"):
            for colon in (":", ";"):
                for end in GNU_ENDS:
                    yield f"{spdx} header", (GNU_HEADER + end).format(what=what, colon=colon, name=name, version=version)

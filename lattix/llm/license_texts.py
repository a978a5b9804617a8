"""Whole texts and notices of common licences, as (identifier, text)."""

from __future__ import annotations

from pathlib import Path

BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Whole texts in ``texts``, by file name.
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
#: What follows this line tells how to apply the licence; texts are known with and without it.
END = "END OF TERMS AND CONDITIONS"
#: Names in notices.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MPL-1.1": ["Mozilla Public License, version 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL version 3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "Unlicense": ["Unlicense"],
}
FORMS = ["Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This software is licensed under the {}.", "This project is licensed under the {}."]
CC_NAMES = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _whole() -> list[tuple[str, str]]:
    bsd3 = BSD_START + BSD_NAMES + BSD_END
    found = [("BSD-2-Clause", BSD_START + BSD_END), ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD_START + BSD_END), ("BSD-3-Clause", bsd3), ("BSD-3-Clause", "BSD 3-Clause License\n" + bsd3)]
    found += [("Unlicense", UNLICENSE), ("Unlicense", UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>"), ("Unlicense", UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>")]
    for name, key in FILES.items():
        text = (Path(__file__).parent / "texts" / f"{name}.txt").read_text("utf-8")
        found.append((key, text))
        if END in text:
            found += [(key, text.split(END)[0] + END), (key, text.split(END)[0])]
    return found


def _notices() -> list[tuple[str, str]]:
    found = [(key, form.format(name)) for key, names in NAMES.items() for name in names for form in FORMS]
    found += [(key, f"SPDX-License-Identifier: {key}{end}") for key in [*NAMES, "LGPL-2.0", "CC0-1.0"] for end in (["", "-only", "-or-later"] if "GPL" in key else [""])]
    for code, name in CC_NAMES.items():
        for version, port in CC_VERSIONS.items():
            key = f"CC-{code}-{version}"
            names = [f"CC {code} {version}", f"a Creative Commons {name} {version} {port} License", f"the Creative Commons {name} {version} {port} License", f"the Creative Commons {name} {version} License"]
            found += [(key, f"{form} {n}.") for n in names for form in ("Licensed under", "Released under", "This work is licensed under")]
            found.append((key, f"SPDX-License-Identifier: {key}"))
    return found


TEXTS = _whole() + _notices()

"""Known licence texts and notices (fixed values, in their published wording).

Whole texts are known with and without their title; the long ones are files of
``licenses``, of which the value in ``TITLE_LINES`` says how many lines the title has.
"""

from importlib import resources

KNOWN_TEXTS = {
    # one-line notices
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    # whole texts
    "0BSD text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}

TITLE_LINES = {"Apache-2.0": 3, "Artistic-1.0-Perl": 1, "BSD-2-Clause": 0, "BSD-3-Clause": 0, "BSD-3-Clause-UC": 0, "CC0-1.0": 2, "GFDL-1.2": 2, "GFDL-1.3": 2, "GPL-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2,
               "LGPL-2.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-1.1": 3, "MPL-2.0": 2, "Unlicense": 0}
#: Titles that texts without one in their own wording are found under.
TITLES = {"0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD License"),
          "ISC": ("ISC License", "The ISC License"), "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "Unlicense": ("The Unlicense", "Unlicense"), "Zlib": ("zlib License", "The zlib License")}
#: Texts after whose terms an appendix on how to use them may be left out.
END = "END OF TERMS AND CONDITIONS"


def _numbered(text: str) -> str:
    """The text with the clauses that have a star numbered."""
    first, *clauses = ("\n" + text).split("\n* ")
    return first + "".join(f"\n{i}. {x}" for i, x in enumerate(clauses, 1))


def _without_title(text: str, n: int) -> str:
    lines = [x for x in text.split("\n") if x.strip()]
    return "\n".join(lines[n:])


for _name, _n in TITLE_LINES.items():
    _text = resources.files("panelforge.llm").joinpath("licenses", f"{_name}.txt").read_text("utf-8")
    _forms = {"": _text}
    if _name in ("BSD-2-Clause", "BSD-3-Clause"):
        _forms[", numbered"] = _numbered("\n".join(x.strip() for x in _text.split("\n")))
    if END in _text and _text.split(END)[1].strip():
        _forms[" without appendix"] = _text.split(END)[0] + END
    for _form, _text in _forms.items():
        KNOWN_TEXTS[f"{_name} text{_form}"] = _text
        if _n:
            KNOWN_TEXTS[f"{_name} text{_form}, no title"] = _without_title(_text, _n)
for _name in [x for x in KNOWN_TEXTS if " text" in x]:
    for _i, _title in enumerate(TITLES.get(_name.split(" text")[0], ())):
        KNOWN_TEXTS[f"{_name}, title {_i + 1}"] = f"{_title}\n\n{KNOWN_TEXTS[_name]}"

"""Licences by similarity of word pairs with short reference texts."""

from __future__ import annotations

import re

THRESHOLD = 0.85
TEXTS = {
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "Apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "Unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}


def _pairs(text: str) -> set[tuple[str, str]]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return set(zip(words, words[1:]))


_REFERENCE = {name: _pairs(text) for name, text in TEXTS.items()}


def detect(text: str, threshold: float = THRESHOLD) -> tuple[str, float] | None:
    """The licence whose word pairs the text holds the largest share of."""
    found = _pairs(text)
    name, share = max(((n, len(p & found) / len(p)) for n, p in _REFERENCE.items()), key=lambda x: x[1])
    return (name, share) if share >= threshold else None

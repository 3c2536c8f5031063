"""What licences are told by besides one line: full texts (files here), standard headers, titles."""

from __future__ import annotations

from pathlib import Path

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
    "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_CC = "This work is licensed under a Creative Commons {} 4.0 International License"
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
    "with the License. You may obtain a copy of the License at"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_NEITHER = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_CC_KINDS = {
    "CC-BY-4.0": "Attribution",
    "CC-BY-SA-4.0": "Attribution-ShareAlike",
    "CC-BY-NC-4.0": "Attribution-NonCommercial",
    "CC-BY-ND-4.0": "Attribution-NoDerivatives",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-NC-ND-4.0": "Attribution-NonCommercial-NoDerivatives",
}
#: Standard notices, by SPDX identifier.
HEADERS: dict[str, list[str]] = {
    "Apache-2.0": [
        _APACHE,
        f"{_APACHE} http://www.apache.org/licenses/LICENSE-2.0",
        f"{_APACHE} http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL-2.0": [_GNU.format("General Public License", "2")],
    "GPL-3.0": [_GNU.format("General Public License", "3")],
    "LGPL-2.1": [_GNU.format("Lesser General Public License", "2.1")],
    "LGPL-3.0": [_GNU.format("Lesser General Public License", "3")],
    "AGPL-3.0": [_GNU.format("Affero General Public License", "3")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-2-Clause": [_BSD],
    "BSD-3-Clause": [f"{_BSD} {_NEITHER}", _NEITHER],
    **{name: [_CC.format(kind)] for name, kind in _CC_KINDS.items()},
}
#: Lines or blocks that are nothing but a licence's name, as lower-case words.
TITLES: dict[str, str] = {
    **{t: "MIT" for t in ("mit license", "the mit license", "mit license mit", "the mit license mit")},
    **{t: "Apache-2.0" for t in ("apache license 2.0", "apache license version 2.0", "apache license version 2.0 january 2004")},
    **{t: "GPL-2.0" for t in ("gnu general public license version 2", "gnu general public license version 2 june 1991")},
    **{t: "GPL-3.0" for t in ("gnu general public license version 3", "gnu general public license version 3 29 june 2007")},
    **{t: "LGPL-2.1" for t in ("gnu lesser general public license version 2.1", "gnu lesser general public license version 2.1 february 1999")},
    **{t: "LGPL-3.0" for t in ("gnu lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007")},
    **{t: "AGPL-3.0" for t in ("gnu affero general public license version 3", "gnu affero general public license version 3 19 november 2007")},
    **{t: "MPL-2.0" for t in ("mozilla public license version 2.0", "mozilla public license 2.0")},
    **{t: "BSD-2-Clause" for t in ("bsd 2-clause license", "the bsd 2-clause license")},
    **{t: "BSD-3-Clause" for t in ("bsd 3-clause license", "the bsd 3-clause license")},
    **{t: "CC0-1.0" for t in ("cc0 1.0 universal", "creative commons legal code cc0 1.0 universal")},
    **{
        f"{first}{kind.lower()} 4.0 international{last}": name
        for name, kind in _CC_KINDS.items() for first in ("", "creative commons ") for last in ("", " license", " public license")
    },
}


def full_texts() -> dict[str, str]:
    """The licence texts in this folder, by SPDX identifier."""
    return {p.stem: p.read_text("utf-8") for p in sorted(Path(__file__).parent.glob("*.txt"))}

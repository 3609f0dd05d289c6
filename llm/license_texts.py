"""Phrases and license texts that the scan looks for.

Fixed values, as their publishers give them; a text is a passage of a license or of its usual notice, in which a name and a year may stand
between the words.
"""

#: (phrase, label): places of these are counted word by word.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: (notice, label): short notices, which must stand word by word too.
NOTICES = [
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license version 2", "gpl-2"),
    ("gnu general public license version 3", "gpl-3"),
    ("gnu general public license v2", "gpl-2"),
    ("gnu general public license v3", "gpl-3"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("mozilla public license version 2", "mpl-2"),
    ("eclipse public license", "epl"),
    ("boost software license version 1", "bsl-1"),
    ("bsd 2 clause license", "bsd-2"),
    ("bsd 3 clause license", "bsd-3"),
    ("under the isc license", "isc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("creative commons zero", "cc0"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("spdx license identifier mit", "mit"),
    ("spdx license identifier apache 2", "apache-2"),
    ("spdx license identifier gpl 2", "gpl-2"),
    ("spdx license identifier gpl 3", "gpl-3"),
    ("spdx license identifier mpl 2", "mpl-2"),
    ("spdx license identifier bsd 2 clause", "bsd-2"),
    ("spdx license identifier bsd 3 clause", "bsd-3"),
]

#: (text, label): found where most of the text stands, with words put in, left out or changed.
TEXTS = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache-2",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "gpl-3",
    ),
    (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version.",
        "gpl-2",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mpl-2",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    (
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
        "cc0",
    ),
]

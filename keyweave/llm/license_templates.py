"""Wording of public licenses, of the notices that refer to them, and their names, as templates for `license_scan`.

Words are lower-case runs of letters and digits, as the scan takes them; `[[ ... ]]` may be left out and `{{m,n}}` stands
for m to n words of any kind. Several templates may have the same wording in part; each is accepted on its own.
"""

# How versions are written; "2.0" is two words, "v2" is one.
VERSION = " [[version]] [[v]] [[v1]] [[v2]] [[v3]] [[1]] [[2]] [[3]] [[4]] [[5]] [[0]] [[1]] "

# Names of licenses that are no base phrase.
NAMES = {
    "agpl": "gnu affero general public license" + VERSION,
    "lgpl": "gnu lesser general public license" + VERSION,
    "lgpl-name": "lgpl" + VERSION,
    "agpl-name": "agpl" + VERSION,
    "mpl": "mozilla public license" + VERSION,
    "epl": "eclipse public license" + VERSION,
    "bsd-2-clause": "bsd 2 clause [[simplified]] [[license]]",
    "bsd-3-clause": "bsd 3 clause [[new]] [[or]] [[revised]] [[license]]",
    "bsl-1.0": "boost software license" + VERSION,
    "artistic-name": "artistic license" + VERSION,
    "isc-name": "isc license",
    "zlib-name": "zlib license",
    "unlicense-name": "the unlicense",
    "cc0": "cc0 [[1]] [[0]] [[universal]]",
    "cc-by-sa": "creative commons attribution [[noncommercial]] sharealike" + VERSION + "[[international]] [[unported]] [[public]] [[license]]",
    "cc-by-nc": "creative commons attribution noncommercial" + VERSION + "[[international]] [[unported]] [[public]] [[license]]",
    "cc-by-legal": "creative commons attribution" + VERSION + "[[international]] [[unported]] public license",
    "spdx": "spdx license identifier {{1,1}}" + VERSION + "[[only]] [[or]] [[later]] [[clause]]",
}

# Notices by which a work refers to its license.
NOTICES = {
    "mit-notice": "[[this {{1,3}} is]] released under the [[terms of the]] mit license",
    "apache-2.0": """licensed under the apache license version 2 0 [[the license [[you may not use this file except in
        compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses
        license 2 0 [[unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the
        license for the specific language governing permissions and limitations under the license]]]]]]""",
    "gpl-notice": "[[this {{1,3}} is]] licensed under the [[terms of the]] gnu general public license" + VERSION,
    "gpl-header": """is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version {{1,1}} of the license or at your option any later version""",
    "lgpl-header": """is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]]
        [[library]] general public license as published by the free software foundation either version {{1,2}} of the
        license or at your option any later version this {{1,2}} is distributed in the hope that it will be useful but
        without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see
        the gnu [[lesser]] [[library]] general public license for more details""",
    "agpl-header": """is free software you can redistribute it and or modify it under the terms of the gnu affero general
        public license as published by the free software foundation either version {{1,1}} of the license or at your option
        any later version""",
    "gpl-warranty": """is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[library]] [[affero]]
        general public license for more details""",
    "mpl-2.0-header": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the
        mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0""",
    "bsl-1.0-notice": "distributed under the boost software license version 1 0 [[see accompanying file {{1,4}} or copy at [[http]] [[https]] www boost org license 1 0 txt]]",
    "cc-by-notice": """[[this {{1,3}} is]] licensed under [[a]] [[the]] [[creative commons]] [[attribution]] cc by [[nc]] [[nd]]
        [[sa]]""" + VERSION + "[[international]] [[unported]] [[license]]",
    "cc-notice": """this {{1,3}} is licensed under a creative commons attribution [[noncommercial]] [[noderivatives]]
        [[noderivs]] [[sharealike]]""" + VERSION + "[[international]] [[unported]] license",
}

# The grants and conditions of licenses.
TEXTS = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the
        software the software is provided as is without warranty of any kind express or implied including but not limited to
        the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        {{1,8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies""",
    "0bsd": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted the software is provided as is and {{1,3}} disclaims all warranties with regard to this software""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice
        this list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution [[ [[3]] neither the name of {{1,8}} nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission]]""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software
        for any purpose including commercial applications and to alter it and redistribute it freely""",
    "bsl-1.0-text": """permission is hereby granted free of charge to any person or organization obtaining a copy of the
        software and accompanying documentation covered by this license the software to use reproduce display distribute
        execute and transmit the software""",
    "unlicense": """this is free and unencumbered software released into the public domain [[anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means]]""",
    "apache-2.0-grant": """each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free
        irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense
        and distribute the work and such derivative works in source or object form""",
    "gpl-preamble": """the gnu general public license is a free copyleft license for software and other kinds of works""",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}

TEMPLATES = NAMES | NOTICES | TEXTS

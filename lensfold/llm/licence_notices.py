"""Templates beside the one-line ones: notices of licence headers in their usual variants, and licence texts as a whole.

Fixed values. Texts lie in ``licence_texts``, named by SPDX id; only the driver reads them. AGPL-3.0 is made from the text of
GPL-3.0, from which it differs by the name and one section. The texts of the CC BY family are known by their titles only.
"""

from __future__ import annotations

from pathlib import Path

#: SPDX ids of each licence in use, and the names that notices give it.
NAMES = {
    "AGPL-3.0": (("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), ("GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU Affero General Public License v3", "AGPLv3", "AGPL 3.0")),
    "Apache-2.0": (("Apache-2.0",), ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache License v2.0", "Apache 2", "Apache Software License")),
    "BSD-2-Clause": (("BSD-2-Clause", "BSD-2-Clause-FreeBSD"), ("2-Clause BSD", "BSD 2-Clause", "BSD 2-Clause \"Simplified\"", "two-clause BSD", "Simplified BSD", "FreeBSD")),
    "BSD-3-Clause": (("BSD-3-Clause",), ("3-Clause BSD", "BSD 3-Clause", "BSD 3-Clause \"New\" or \"Revised\"", "three-clause BSD", "New BSD", "Modified BSD", "BSD-style", "BSD")),
    "BSL-1.0": (("BSL-1.0",), ("Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License")),
    "CC-BY-4.0": (("CC-BY-4.0",), ("Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0", "Attribution 4.0 International", "CC BY 4.0")),
    "CC-BY-NC-4.0": (("CC-BY-NC-4.0",), ("Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0", "Attribution-NonCommercial 4.0 International", "CC BY-NC 4.0")),
    "CC-BY-SA-4.0": (("CC-BY-SA-4.0",), ("Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0", "Attribution-ShareAlike 4.0 International", "CC BY-SA 4.0")),
    "CC-BY-NC-ND-4.0": (("CC-BY-NC-ND-4.0",), ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International", "CC BY-NC-ND 4.0")),
    "CC-BY-NC-SA-4.0": (("CC-BY-NC-SA-4.0",), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "CC BY-NC-SA 4.0")),
    "CC-BY-ND-4.0": (("CC-BY-ND-4.0",), ("Creative Commons Attribution-NoDerivatives 4.0 International", "CC BY-ND 4.0")),
    "CC0-1.0": (("CC0-1.0",), ("CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0", "CC0")),
    "CDDL-1.0": (("CDDL-1.0",), ("Common Development and Distribution License 1.0", "Common Development and Distribution License, Version 1.0", "CDDL 1.0")),
    "EPL-2.0": (("EPL-2.0",), ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "EPL 2.0")),
    "EUPL-1.2": (("EUPL-1.2",), ("European Union Public License, Version 1.2", "European Union Public Licence 1.2", "EUPL 1.2")),
    "GPL-2.0": (("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), ("GNU General Public License version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL version 2", "GNU GPL v2", "GPLv2", "GPL v2", "GPL 2.0", "GPL version 2")),
    "GPL-3.0": (("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), ("GNU General Public License version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL version 3", "GNU GPL v3", "GPLv3", "GPL v3", "GPL 3.0", "GPL version 3")),
    "ISC": (("ISC",), ("ISC",)),
    "LGPL-2.1": (("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"), ("GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL 2.1", "LGPL version 2.1")),
    "LGPL-3.0": (("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), ("GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License v3", "LGPLv3", "LGPL 3.0", "LGPL version 3")),
    "MIT": (("MIT",), ("MIT", "MIT/Expat")),
    "MPL-2.0": (("MPL-2.0",), ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "MPL 2.0")),
    "Unlicense": (("Unlicense",), ("The Unlicense",)),
    "Zlib": (("Zlib",), ("zlib", "zlib/libpng")),
}
FRAMES = ("Licensed under the {} license", "Released under the {} license", "Distributed under the terms of the {} license", "License: {} license", "{} license")
GPL = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
    "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License version {} as published by the Free Software Foundation.",
)
#: Sentences of headers and of short licence texts that tell one licence from the others.
SENTENCES = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'The ASF licenses this file to You under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("Apache-2.0 OR MIT", "This project is dual licensed under the Apache License, Version 2.0 and the MIT license."),
    ("Apache-2.0 OR MIT", "SPDX-License-Identifier: Apache-2.0 OR MIT"),
    ("Apache-2.0 OR MIT", "SPDX-License-Identifier: MIT OR Apache-2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "Use of this source code is governed by an MIT license that can be found in the LICENSE file."),
    ("MIT", "Licensed under the MIT License. See LICENSE file in the project root for full license information."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("All-rights-reserved", "Copyright. All rights reserved."),
    ("All-rights-reserved", "All rights reserved."),
    *[(licence, g.format(work, kind, v)) for licence, kind, v in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")) for g in GPL for work in ("program", "library")],
]
HEADERS = tuple(
    SENTENCES
    + [(licence, f.format(name)) for licence, (_, names) in NAMES.items() for name in names for f in FRAMES]
    + [(licence, f"SPDX-License-Identifier: {i}") for licence, (ids, _) in NAMES.items() for i in ids]
    + [(licence, f"License: {i}") for licence, (ids, _) in NAMES.items() for i in ids]
)
#: What headers name licences by, joined; the bare word MIT is also a German one.
NAMING_WORDS = " ".join(["MIT license; SPDX; rights reserved; public domain; unencumbered"] + [n for licence, (ids, names) in NAMES.items() if licence != "MIT" for n in (*ids, *names)])


def texts() -> tuple[tuple[str, str], ...]:
    """(licence, text) of whole licence texts."""
    found = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    affero = "Remote Network Interaction. If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source from a network server at no charge."
    found["AGPL-3.0"] = found["GPL-3.0"].replace("GNU General Public License", "GNU Affero General Public License").replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC") + affero
    return tuple(sorted(found.items()))

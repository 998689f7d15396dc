"""Known licence texts and notice lines, by SPDX identifier."""

# Public licence texts, without their copyright lines.
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so"
)
_NOTICE_MIT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CLAUSES_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_CLAUSE_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n"
)
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)

TEXTS: list[tuple[str, str]] = [
    ("MIT", f"MIT License\n\n{_GRANT_MIT}, subject to the following conditions:\n\n{_NOTICE_MIT}\n\n{_WARRANTY_MIT}"),
    ("MIT", f"The MIT License (MIT)\n\n{_GRANT_MIT}, subject to the following conditions:\n\n{_NOTICE_MIT}\n\n{_WARRANTY_MIT}"),
    ("MIT", f"{_GRANT_MIT}, subject to the following conditions:\n\n{_NOTICE_MIT}\n\n{_WARRANTY_MIT}"),
    ("MIT-0", f"MIT No Attribution\n\n{_GRANT_MIT}.\n\n{_WARRANTY_MIT}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_CLAUSES_BSD}\n{_WARRANTY_BSD}"),
    ("BSD-2-Clause", f"{_CLAUSES_BSD}\n{_WARRANTY_BSD}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_CLAUSES_BSD}{_CLAUSE_3}\n{_WARRANTY_BSD}"),
    ("BSD-3-Clause", f"{_CLAUSES_BSD}{_CLAUSE_3}\n{_WARRANTY_BSD}"),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        f"hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_WARRANTY_ISC}",
    ),
    (
        "0BSD",
        "BSD Zero Clause License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or "
        f"without fee is hereby granted.\n\n{_WARRANTY_ISC}",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the "
        "original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "WTFPL",
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n"
        "0. You just DO WHAT THE FUCK YOU WANT TO.",
    ),
    (
        "FSFAP",
        "Copying and distribution of this file, with or without modification, are permitted in any medium without royalty "
        "provided the copyright notice and this notice are preserved. This file is offered as-is, without any warranty.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors "
        "of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication "
        "for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be "
        "an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer "
        "to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or "
        "organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to "
        "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, "
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and the following "
        "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source "
        'language processor.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

# Licence, title and version, which part of its text, characters and SHA-256 of that part's canonical form
# (see licenses.canonical), for texts that are too long to be kept here. The texts are those that Debian installs under
# /usr/share/common-licenses. Parts: the whole file with its closing instructions, the file up to the line
# "END OF TERMS AND CONDITIONS" with that line, and the file up to before it.
DIGESTS: list[tuple[str, str, str, int, str]] = [
    ("Apache-2.0", "Apache License, Version 2.0, January 2004", "whole", 9888,
     "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5"),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004", "terms and their end line", 8871,
     "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004", "terms", 8843,
     "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Artistic-1.0-Perl", 'The "Artistic License" (of Perl)', "whole", 5833,
     "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "Creative Commons Legal Code, CC0 1.0 Universal", "whole", 6692,
     "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "GNU Free Documentation License, Version 1.2, November 2002", "whole", 19606,
     "5a3b24c0d356ef8989faaaabae94f88aae352636c3cd36da5f5a76f39cd16b83"),
    ("GFDL-1.3-only", "GNU Free Documentation License, Version 1.3, 3 November 2008", "whole", 22042,
     "9330d425b8d1073fd89f543fb54e3a4b4c91abbbcd9a5b933b57f3edc95832bd"),
    ("GPL-1.0-only", "GNU General Public License, Version 1, February 1989", "whole", 11795,
     "98b577d60405d0dae6a71659318e8cef824021d2e612f9c0801106c9e569e32c"),
    ("GPL-1.0-only", "GNU General Public License, Version 1, February 1989", "terms and their end line", 9415,
     "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0-only", "GNU General Public License, Version 1, February 1989", "terms", 9387,
     "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-2.0-only", "GNU General Public License, Version 2, June 1991", "whole", 17115,
     "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-2.0-only", "GNU General Public License, Version 2, June 1991", "terms and their end line", 14483,
     "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0-only", "GNU General Public License, Version 2, June 1991", "terms", 14455,
     "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-3.0-only", "GNU General Public License, Version 3, 29 June 2007", "whole", 33406,
     "e45fdf2ecb0f05dd188636cd45a7e9be8d0af6c375e83667e79460782b04dd25"),
    ("GPL-3.0-only", "GNU General Public License, Version 3, 29 June 2007", "terms and their end line", 30967,
     "7d75204ed685fd08ff55e7de654cd69da831b4d875c3d2c2e69d04d738cccc3e"),
    ("GPL-3.0-only", "GNU General Public License, Version 3, 29 June 2007", "terms", 30939,
     "dd35883083089e6d76ba8a178db431b99ae33b3d2e87dc33fa479fe6aa2ce307"),
    ("LGPL-2.0-only", "GNU Library General Public License, Version 2, June 1991", "whole", 24128,
     "e4deecd0730802431ad09f00ae3793f3703c8e4dba639586545d9f958405614d"),
    ("LGPL-2.0-only", "GNU Library General Public License, Version 2, June 1991", "terms and their end line", 22277,
     "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0-only", "GNU Library General Public License, Version 2, June 1991", "terms", 22249,
     "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, Version 2.1, February 1999", "whole", 25215,
     "d3826e4e563a04a354453ff139a32b19d6c3fe283f518eb566107c54e18cd01f"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, Version 2.1, February 1999", "terms and their end line", 23365,
     "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1-only", "GNU Lesser General Public License, Version 2.1, February 1999", "terms", 23337,
     "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0-only", "GNU Lesser General Public License, Version 3, 29 June 2007", "whole", 7104,
     "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "Mozilla Public License, Version 1.1", "whole", 22466,
     "306c97d6d414b6d81e284c065ce46bb98866841c27e12248e4f16e85936a1474"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0", "whole", 14343,
     "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6"),
]

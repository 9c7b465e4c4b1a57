"""Public licence texts, one-line notices and equivalent spellings."""

_MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
    "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
    'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
    "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
    "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1 = "{}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_2 = "{}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "{}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted{}. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
    "USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _bsd(*clauses: str, marks: tuple[str, ...]) -> str:
    return _BSD_HEAD + "".join(c.format(m) for c, m in zip(clauses, marks, strict=True)) + _BSD_TAIL


_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"

#: Whole licences, with and without their titles and with either kind of list marks.
TEXTS = {
    _MIT_BODY: "MIT",
    "MIT License\n\n" + _MIT_BODY: "MIT",
    "The MIT License (MIT)\n\n" + _MIT_BODY: "MIT",
    "The MIT License\n\n" + _MIT_BODY: "MIT",
    _bsd(_BSD_1, _BSD_2, marks=("1. ", "2. ")): "BSD-2-Clause",
    _bsd(_BSD_1, _BSD_2, marks=("* ", "* ")): "BSD-2-Clause",
    "BSD 2-Clause License\n\n" + _bsd(_BSD_1, _BSD_2, marks=("1. ", "2. ")): "BSD-2-Clause",
    _bsd(_BSD_1, _BSD_2, _BSD_3, marks=("1. ", "2. ", "3. ")): "BSD-3-Clause",
    _bsd(_BSD_1, _BSD_2, _BSD_3, marks=("* ", "* ", "* ")): "BSD-3-Clause",
    "BSD 3-Clause License\n\n" + _bsd(_BSD_1, _BSD_2, _BSD_3, marks=("1. ", "2. ", "3. ")): "BSD-3-Clause",
    _ISC.format(_NOTICE): "ISC",
    "ISC License\n\n" + _ISC.format(_NOTICE): "ISC",
    _ISC.format(""): "0BSD",
    "BSD Zero Clause License\n\n" + _ISC.format(""): "0BSD",
}

#: Notices that stand as a line of a text.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
    "Released under the Apache License, Version 2.0.": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "This work is licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC0 1.0.": "CC0-1.0",
    "Released under the BSD 3-Clause License.": "BSD-3-Clause",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "Released under the BSD 2-Clause License.": "BSD-2-Clause",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "Released under the ISC License.": "ISC",
    "SPDX-License-Identifier: ISC": "ISC",
    "This work is in the public domain.": "public-domain",
}

#: Spellings that licence matching takes for the same word.
SPELLINGS = {
    "license": ("licence",),
    "licensed": ("licenced",),
    "licenses": ("licences",),
    "sublicense": ("sub license", "sublicence", "sub licence"),
    "noninfringement": ("non infringement",),
    "noncommercial": ("non commercial",),
    "merchantability": ("merchantibility",),
    "acknowledgment": ("acknowledgement",),
    "authorized": ("authorised",),
    "organization": ("organisation",),
    "copyright holder": ("copyright owner",),
    "copyright holders": ("copyright owners",),
    "favor": ("favour",),
    "fulfill": ("fulfil",),
    "judgment": ("judgement",),
    "percent": ("per cent",),
    "while": ("whilst",),
    "and or": ("andor",),
}

#: Canonical digests of longer whole texts, each with and without its appendix and in both URL schemes.
DIGESTS = {
    "Apache-2.0": (
        "0bd92ecab6c9ae6d797ceea4eaf189857999b290b26b0da8e9dc0ff3c30a34e8",
        "3cadc7d4f362979643c5bb255c4c9d67312a93c3c4af0667dd141c2b18817454",
        "6537484b35791c1a5da5423a0ec37a0b53cf576633f99dbc6cbbc082d0cd8d66",
        "7344d7b010ed06669d02fd695b0ad14b4f233520668c35c46d585f981ed64e02",
        "8ab25d713641c4b0ebccdc1c14ffc6fcf46332ee1f3e9b44b38325000ffb3b0b",
        "9446b99128ec9c3946adbb681853599f3a5f01a69d6c0762a9d0ab699868d801",
        "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0",
        "bb531182159142b308d308fe34391e6848d93f2a2ed991087b686ec75f9dbb1d",
        "c348fad4100086120c9a4f71602579f6f49d5ca97ae96d36cf377b10e6e79871",
        "c46dfd45ed4a19fe4a99eaed08590a0c093e3a0b73c293ece466f468b902aff3",
        "c936c3be4c0e23ce771b851922c44c2c6bbb0fb8c42f59ae99cf57ebd223697c",
        "ef3211463b904cb61f1da41dbb54ffd6b734df8875b1247dc5553607e160be35",
    ),
    "BSL-1.0": (
        "4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6",
    ),
    "CC-BY-SA-4.0": (
        "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d",
    ),
    "CC0-1.0": (
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    ),
    "GFDL-1.2": (
        "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
        "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    ),
    "GFDL-1.3": (
        "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
        "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    ),
    "GPL-1.0": (
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    ),
    "GPL-2.0": (
        "031ce0347a7bfaa9fea9fb34dc0def0f70d366e9b6aeab50cf9537178d0d9d50",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75",
        "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    ),
    "GPL-3.0": (
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "0d3bfcceda6470dcd13089cae938e4e0251be32d7ab34ca76aea6195a56230bf",
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    ),
    "LGPL-2.0": (
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    ),
    "LGPL-2.1": (
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
        "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    ),
    "MPL-2.0": (
        "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13",
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ),
    "Unlicense": (
        "8d3909f4543649cfba0b0b1fc765c67acf3736106a78237ea2972f83eaa7dd3e",
        "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229",
    ),
    "Zlib": (
        "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7",
    ),
}

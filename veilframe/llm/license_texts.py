"""Signatures written one by one, from the wording of licenses, of notices and of tools.

``SIGNATURES``: label, keyword, pattern.  A space stands for a short gap between words;
every match holds the keyword.  ``EXCEPTIONS`` stand above the license they add to.
``NEGATIVES`` have no label: what lies inside of one is no detection.
"""

SIGNATURES = (
    # Permissive licenses: what they grant, ask for and disclaim.
    ("mit", "limitation", r"without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies"),
    ("mit", "substantial", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "persons", r"permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "contributors", r"mit licensed (?:by )?(?:the )?contributors"),
    ("mit", "mit", r"(?:dual )?licensed under (?:the )?mit(?: or| and|$|\.|;)"),
    ("mit-advertising", "advertising", r"except as contained in this notice the names? of .{1,60} shall not be used in advertising"),
    ("x11", "consortium", r"the name of the x consortium shall not be used in advertising"),
    ("x11", "consortium", r"x consortium is a trademark of"),
    ("mit-modern", "hereby", r"permission is hereby granted without written agreement and without license or royalty fees"),
    ("hpnd", "supporting", r"appear in (?:all copies and in )?supporting documentation"),
    ("hpnd", "representations", r"makes no representations about the suitability of this software for any purpose"),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("isc", "negligence", r"action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("isc", "internet", r"internet systems consortium license"),
    ("bsd-2", "retain", r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions"),
    ("bsd-2", "reproduce", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd-3", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "regents", r"the regents of the university of california"),
    ("bsd", "merchantability", r"the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd", "exemplary", r"direct indirect incidental special exemplary or consequential damages"),
    ("bsd", "bsd", r"(?:new|revised|modified|simplified) bsd licen[cs]e"),
    ("bsd", "style", r"bsd style (?:open source )?licen[cs]e"),
    ("bsd-4", "display", r"must display the following acknowledge?ment"),
    ("bsd-patent", "patent", r"bsd (?:2 clause )?plus patent"),
    ("bsd-facebook", "patents", r"an additional grant of patent rights can be found in the patents file"),
    ("ncsa", "illinois", r"university of illinois ncsa"),
    ("apache-1.1", "foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-2", "implied", r"without warranties or conditions of any kind either express or implied"),
    ("apache-2", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache-2", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "unless", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache-2", "apache", r"apache(?: licen[cs]e)? v?2(?:\.0)?"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("libpng", "contributing", r"the contributing authors and group 42 inc disclaim all warranties"),
    ("bsl-1", "derivative", r"must be included in all copies of the software in whole or in part and all derivative works"),
    ("bsl-1", "boost", r"distributed under the boost software license"),
    ("openssl", "toolkit", r"for use in the openssl toolkit"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("python-2", "psf", r"psf is making python available to licensee on an as is basis"),
    ("python-2", "foundation", r"copyright (?:c )?(?:[0-9,\x20-]+)?python software foundation all rights reserved"),
    ("php-3.01", "php", r"this product includes php software freely available from"),
    ("tcl", "regents", r"copyrighted by the regents of the university of california sun microsystems"),
    ("postgresql", "postgresql", r"postgresql database management system formerly known as postgres"),
    ("unicode", "unicode", r"unicode data files (?:and|or) software"),
    ("icu", "international", r"international business machines corporation and others all rights reserved"),
    ("ntp", "suitability", r"the university of delaware makes no representations about the suitability"),
    ("afl-3", "academic", r"licensed under the academic free license"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("wtfpl", "fuck", r"you just do what the fuck you want to"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("naist", "institute", r"nara institute of science and technology"),
    ("ftl", "freetype", r"(?:the )?freetype (?:project )?licen[cs]e"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("info-zip", "zip", r"info zip (?:license|disclaims|is provided)"),
    ("w3c", "w3c", r"w3c r? ?software (?:notice|and document)"),
    ("fsf-notice", "unlimited", r"(?:the )?free software foundation (?:inc )?gives unlimited permission to copy"),
    ("fsf-notice", "verbatim", r"verbatim copying and distribution of this entire article"),
    # Copyleft licenses.
    ("gpl", "hope", r"this program is distributed in the hope that it will be useful"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license"),
    ("gpl", "freedom", r"the licenses for most software are designed to take away your freedom"),
    ("gpl", "copyleft", r"gnu (?:gpl|general public licen[cs]e) is a (?:free )?copyleft licen[cs]e"),
    ("gpl", "gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?2(?:\.0)?(?: only)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?3(?:\.0)?(?: only)?"),
    ("gpl-2-plus", "gpl", r"(?:gnu )?gpl ?v?2(?:\.0)?(?:\+| or (?:any )?(?:later|newer|above))"),
    ("gpl-3-plus", "gpl", r"(?:gnu )?gpl ?v?3(?:\.0)?(?:\+| or (?:any )?(?:later|newer|above))"),
    ("gpl-2-plus", "option", r"either version 2 of the license or at your option any later version"),
    ("gpl-3-plus", "option", r"either version 3 of the license or at your option any later version"),
    ("gpl-1-plus", "option", r"either version 1 or at your option any later version"),
    ("gpl-2", "version", r"gnu general public license version 2 (?:only|as published by the free software foundation)"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "library", r"this library is distributed in the hope that it will be useful"),
    ("lgpl-2.1", "option", r"either version 2\.1 of the license or at your option any later version"),
    ("lgpl", "lgpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?lgpl"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v?2\.1"),
    ("lgpl-3", "lgpl", r"lgpl ?v?3(?:\.0)?"),
    ("agpl-3", "agpl", r"agpl ?v?3(?:\.0)?"),
    ("agpl", "remotely", r"all users interacting with it remotely through a computer network"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "invariant", r"with no invariant sections with no front cover texts and with no back cover texts"),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation"),
    ("mpl-1.1", "basis", r"software distributed under the license is distributed on an as is basis"),
    ("mpl-1.1", "alternatively", r"alternatively the contents of this file may be used under the terms of"),
    ("mpl-1.1", "developer", r"the initial developer of the original code is"),
    ("mpl-2", "mozilla", r"if a copy of the mpl was not distributed with this file you can obtain one at (?:https? )?(?:www )?mozilla"),
    ("mpl-2", "secondary", r"this source code form is incompatible with secondary licenses"),
    ("mpl-2", "mpl", r"mpl ?v?2(?:\.0)?"),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("edl-1", "eclipse", r"made available under the terms of the eclipse distribution license"),
    ("cddl", "development", r"subject to the terms of the common development and distribution license(?: the license| cddl)?"),
    ("cddl", "header", r"when distributing covered code include this cddl header in each file"),
    ("artistic", "perl", r"under the same terms as perl(?: 5)? itself"),
    ("artistic", "artistic", r"either the gnu general public license or the artistic license"),
    ("osl-3", "software", r"licensed under the open software license version 3\.0"),
    ("ms-pl", "prepare", r"reproduce its contribution prepare derivative works of its contribution"),
    ("eupl", "eupl", r"licensed under the eupl"),
    ("cecill", "french", r"governed by the cecill(?: [abc])? license under french law"),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    # Content and data.
    ("cc0", "waived", r"to the extent possible under law .{1,80} has waived all copyright and related or neighboring rights"),
    ("cc0", "cc0", r"cc0(?: 1\.0)?(?: universal)?"),
    ("cc-by", "creative", r"creative commons attribution [1-4]\.0 (?:unported|international|generic)"),
    ("cc-by-sa", "alike", r"creative commons attribution share ?alike"),
    ("cc-by-nc", "commercial", r"creative commons attribution non commercial"),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes"),
    ("cc-by-nd", "derivatives", r"creative commons attribution no ?derivatives"),
    ("cc-by", "appropriate", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-sa", "contributions", r"you must distribute your contributions under the same license as the original"),
    ("odbl-1", "database", r"made available under the open database license"),
    ("odc-by-1", "commons", r"open data commons attribution licen[cs]e"),
    ("ogl-3", "government", r"(?:contains public sector information )?licensed under the open government licen[cs]e"),
    ("ofl-1.1", "reserved", r"with reserved font names?"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license"),
    ("public-domain", "domain", r"(?:is|are|placed|hereby|put) in(?:to)? the public domain"),
    ("public-domain", "author", r"the author (?:hereby )?disclaims copyright to this source code"),
    ("public-domain", "domain", r"no copyright (?:is claimed|in the united states) .{0,40}public domain"),
    ("unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "perpetuity", r"in perpetuity of all present and future rights to this software under copyright law"),
    # Source available, trial and closed terms.
    ("busl-1.1", "change", r"(?:change date|change license) [0-9a-z]+"),
    ("busl-1.1", "additional", r"additional use grant"),
    ("elastic-2", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1", "service", r"if you make the functionality of the program .{1,60}available to third parties as a service"),
    ("commons-clause", "sell", r"the license does not grant to you the right to sell the software"),
    ("polyform", "polyform", r"polyform (?:shield|perimeter|strict|free trial|internal use|small business)"),
    ("llama", "llama", r"llama [2-4](?:\.[0-9])? community licen[cs]e"),
    ("openrail-m", "restrictions", r"use based restrictions as (?:referenced|set forth) in"),
    ("hippocratic-3", "human", r"must not be used .{1,40}violate human rights"),
    ("academic-only", "only", r"for (?:academic|research|educational)(?: and| or) (?:research|non commercial|academic) (?:use|purposes) only"),
    ("noncommercial", "commercial", r"(?:free )?for (?:personal and )?non ?commercial (?:use|purposes) only"),
    ("evaluation", "evaluation", r"for evaluation (?:purposes )?only"),
    ("proprietary", "reverse", r"you (?:may|shall|must) not reverse engineer decompile or disassemble"),
    ("proprietary", "trade", r"contains (?:confidential and )?(?:proprietary )?trade secrets? of"),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|reproduction|use|distribution) of this (?:file|software|material|document)"),
    ("proprietary", "agreement", r"end user licen[cs]e agreement"),
    ("proprietary", "written", r"without the (?:express|prior) written (?:permission|consent) of the (?:publisher|copyright owner|author)"),
    ("proprietary", "reserved", r"(?:c|copyright) [0-9]{4}(?: [0-9]{4})? .{1,60}all rights reserved"),
    ("export", "export", r"subject to (?:the )?(?:u\.?s\.? )?export (?:control|administration) (?:laws|regulations)"),
    ("government", "duplication", r"use duplication or disclosure by the (?:u\.?s\.? )?government is subject to restrict(?:ed|ions)"),
    # How tools and packages name a license.
    ("mit", "mit", r"license(?: file)?[\"']?\s{0,4}[:=]\s{0,4}[\"'(]?mit[\"')]"),
    ("mit", "mit", r"osi approved (?:::)? ?mit licen[cs]e"),
    ("apache-2", "apache", r"osi approved (?:::)? ?apache software licen[cs]e"),
    ("bsd", "bsd", r"osi approved (?:::)? ?bsd licen[cs]e"),
    ("gpl", "general", r"osi approved (?:::)? ?gnu general public licen[cs]e"),
    ("mit", "module", r"module_license [\"']?(?:dual )?mit"),
    ("gpl", "module", r"module_license [\"']?(?:dual )?(?:bsd|mit)? ?gpl"),
    ("gpl-2", "syscall", r"gpl-2\.0(?:-only)? with linux-syscall-note"),
)

EXCEPTIONS = (
    ("classpath-exception", "independent", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("classpath-exception", "classpath", r"(?:with (?:the )?)?(?:gnu )?classpath (?:linking )?exception"),
    ("gcc-exception", "runtime", r"gcc runtime library exception"),
    ("llvm-exception", "llvm", r"(?:with )?llvm exceptions?"),
    ("linux-syscall-note", "kernel", r"does not cover user programs that use kernel services by normal system calls"),
    ("openssl-exception", "openssl", r"as a special exception .{1,80}permission to link .{1,60}openssl"),
    ("font-exception", "font", r"as a special exception if you create a document which uses this font"),
    ("autoconf-exception", "autoconf", r"as a special exception .{1,60}autoconf"),
    ("bison-exception", "bison", r"you may create a larger work that contains part or all of the bison parser skeleton"),
    ("libtool-exception", "libtool", r"as a special exception .{1,100}gnu libtool"),
    ("static-link-exception", "statically", r"you may (?:link|distribute) .{1,60}statically linked"),
    ("universal-foss-exception", "universal", r"universal foss exception"),
)

NEGATIVES = (
    ("not", r"(?:is|are|was|were|be) not (?:licensed|released|distributed|available|published|covered) (?:under|by) (?:[^.;\n]|\.(?=[0-9])){1,80}"),
    ("longer", r"no longer (?:licensed|released|distributed|available|published|covered) (?:under|by) (?:[^.;\n]|\.(?=[0-9])){1,80}"),
    ("instead", r"instead of (?:the )?[^.;\n]{1,40} licen[cs]e"),
    ("incompatible", r"incompatible with (?:the )?(?:[^.;\n]|\.(?=[0-9])){1,60}"),
    ("similar", r"similar to (?:the )?(?:gnu )?(?:gpl|mit|bsd|apache)(?: licen[cs]e)?"),
    ("compatible", r"compatible with (?:the )?(?:gnu )?(?:gpl|mit|bsd|apache)(?: licen[cs]e)?"),
    ("not", r"not (?:to be confused with|the same as) (?:the )?(?:[^.;\n]|\.(?=[0-9])){1,60}"),
)

"""License scan: ordered signature rules over the words of a text, with DataFrame functions only.

A text is lower-cased and reduced to its words. Rules are regular expressions over these words: hand-written signatures of license bodies, headers and
exceptions, of addresses, and each license's name in each form in which it is named. A prefilter of keywords decides which rules are tried on a text: the words
without which a rule can't match are taken from its own pattern (``needed``), and the longest of them must all stand in the text. Detections have a priority,
and one that lies within the words of a detection of higher priority, or strictly within those of one of equal priority, is suppressed. Besides, plain
phrases give base counts and labels, which stay whatever the rules find.

Defined results: null and empty texts have no words, no labels and score 0. Detections of equal priority over the same words all
stay. Repeated rows get the same result each. Texts are used whole, whatever their length. ``scan`` keeps extra columns, but a column with the name of one that
it adds is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import partial
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, staged, unboxed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same set of letters for Spark: Java tries a class by what it holds several times faster than by what it lacks.
SPARK_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Phrases that the base counts, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: The words by which a phrase is looked for at all.
BASE_WORD = "license"
#: So many of the words that a rule can't do without are looked for before it is tried.
KEYWORDS = 3

#: Signatures of license bodies, headers and exceptions: label, and the words as a pattern.
BODIES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: \\S+){0,12} deal in the software without restriction(?: \\S+){0,20} sublicense"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice(?: \\S+){0,6} shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software(?: \\S+){0,60} to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted(?: without fee)? provided that the above copyright notice appear in all copies and that both(?: that)? copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "neither the name of(?: the)?(?: \\S+){1,8} nor the names of(?: its| any)? contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the(?: copyright holders and contributors| regents and contributors| author) as is and any express or implied warranties"),
    ("bsd-protection", "you may redistribute this program in any form whether modified or not provided that the derivative work"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("libpng", "permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose without fee(?: \\S+){0,60} png"),
    ("ijg", "permission is hereby granted to use copy modify and distribute this software(?: \\S+){0,80} independent jpeg group"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("apache", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? (?:copyright|patent) licen[cs]e"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache", "you may not use this file except in compliance with the licen[cs]e(?: you may obtain a copy of the licen[cs]e at)?"),
    ("apache", "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications"),
    ("apache-1-1", "the end user documentation included with the redistribution if any must include the following acknowledge?ment"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e"),
    ("gpl", "the gnu general public licen[cs]e is a free copyleft licen[cs]e"),
    ("gpl", "the licen[cs]es for most software(?: and other practical works)? are designed to take away your freedom to share and change"),
    ("gpl", "you may (?:convey|copy and distribute) verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2.0", "you may copy and distribute the program or a work based on it under section 2 in object code or executable form under the terms of sections(?: 1 and 2)?"),
    ("gpl-3.0", "protecting users from tivoi[sz]ation"),
    ("gpl-3.0", "no covered work shall be deemed part of an effective technological measure under any applicable law"),
    ("gpl-2.0+", "either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0+", "either version 3 of the licen[cs]e or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty(?: \\S+){0,16} see the gnu (?:lesser|library) general public licen[cs]e"),
    ("lgpl", "the gnu lesser general public licen[cs]e applies to some specially designated software packages typically libraries"),
    ("lgpl", "a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it is called a work that uses the library"),
    ("lgpl-2.1+", "either version 2 1 of the licen[cs]e or at your option any later version"),
    ("agpl", "this program is free software(?: you can redistribute it and or modify)?(?: it)? under the terms of the gnu affero general public licen[cs]e"),
    ("agpl", "all users interacting with it remotely through a computer network"),
    ("agpl", "the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("mpl", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[cs]e version 1 1 the licen[cs]e you may not use this file except in compliance with the licen[cs]e"),
    ("mpl", "the initial developer hereby grants you a world ?wide royalty free non exclusive licen[cs]e"),
    ("mpl", "incompatible with secondary licen[cs]es"),
    ("npl", "the contents of this file are subject to the netscape public licen[cs]e"),
    ("epl", "(?:this program|all rights reserved this program) and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cpl", "the accompanying program is provided under the terms of this common public licen[cs]e"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl", "include this cddl header(?: notice)? in each file"),
    ("eupl", "licen[cs]ed under the eupl(?: version)? 1 [012](?: or as soon they will be approved by the european commission subsequent versions of the eupl)?"),
    ("ms-pl", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e"),
    ("ms-rl", "reciprocal grants for any file you distribute that contains code from the software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("public-domain", "(?:i|we|the authors?) (?:hereby )?(?:release|place|dedicate)s? (?:this|it|the)(?: \\S+){0,6} (?:in|into|to) the public domain"),
    ("public-domain", "(?:is|are|was|were|been) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document(?: \\S+){0,20} do what the fuck you want to"),
    ("beerware", "the beer ware licen[cs]e(?: revision 42)?(?: \\S+){0,12} as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives?"),
    ("cc0", "has (?:dedicated the work to the public domain by waiving|waived) all copyright and related or neighbou?ring rights"),
    ("cc", "by exercising the licen[cs]ed rights(?: defined below)? you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc", "this work is licen[cs]ed under a creative commons(?: \\S+){1,10} licen[cs]e"),
    ("cc-by-nc", "you may not use the (?:material|work) for commercial purposes"),
    ("artistic", "you may distribute this(?: \\S+){1,4} under the terms of(?: either)?(?: the gnu general public licen[cs]e or)? the artistic licen[cs]e"),
    ("artistic", "you may make and give away verbatim copies of the (?:standard version|source form of the standard version) of this package without restriction"),
    ("perl", "(?:free software )?you can redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("psf", "psf is making python available to licensee on an as is basis"),
    ("psf", "this licen[cs]e agreement is between the python software foundation psf and the individual or organization"),
    ("openssl", "redistributions of any form whatsoever must retain the following acknowledge?ment this product includes software developed by the openssl project"),
    ("ofl", "this font software is licen[cs]ed under the sil open font licen[cs]e(?: \\S+){0,20}(?: reserved font name)"),
    ("ofl", "this font software is licen[cs]ed under the sil open font licen[cs]e version 1 [01]"),
    ("ofl", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("ncsa", "neither the names of(?: \\S+){1,8} university of illinois(?: \\S+){1,16} may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("w3c", "permission to(?: use)? copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted(?: \\S+){0,60} w3c"),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is"),
    ("unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("vim", "(?:vim is|this software is) charityware"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public licen[cs]e"),
    ("ruby", "(?:you can redistribute it and or modify it under )?(?:either )?the terms of(?: the)? ruby s? ?licen[cs]e"),
    ("php", "this source file is subject to version (?:3 0|3 01|2 02) of the php licen[cs]e"),
    ("cecill", "this software is governed by the cecill(?: [abc])? licen[cs]e under french law"),
    ("afl", "licen[cs]ed under the academic free licen[cs]e version \\d(?: \\d)?"),
    ("osl", "licen[cs]ed under the open software licen[cs]e version \\d(?: \\d)?"),
    ("sspl", "server side public licen[cs]e(?: version 1)?"),
    ("busl", "business source licen[cs]e(?: version)?(?: 1 1)?"),
    ("busl", "change date(?: \\S+){1,6} change licen[cs]e"),
    ("elastic", "elastic licen[cs]e(?: version)?(?: 2 0| v2)?"),
    ("commons-clause", "commons clause licen[cs]e condition(?: v1 0)?"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[cs]e"),
    ("hippocratic", "hippocratic licen[cs]e"),
    ("parity", "parity public licen[cs]e"),
    ("odbl", "(?:open data commons )?open database licen[cs]e"),
    ("odc-by", "open data commons attribution licen[cs]e"),
    ("pddl", "(?:open data commons )?public domain dedication and licen[cs]e"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e(?: \\S+){0,30} invariant sections"),
    ("gfdl", "gnu free documentation licen[cs]e(?: version 1 [123])?"),
    ("fsfap", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited(?: proprietary and confidential)?"),
    ("proprietary", "(?:this software|this file|this document|the information contained herein) is (?:the )?confidential and proprietary(?: information)?"),
    ("proprietary", "no part of this (?:publication|work|book|software|document) may be reproduced(?: \\S+){0,24} without(?: the)?(?: prior)?(?: express)?(?: written)? permission"),
    ("proprietary", "(?:its|our|their) licensors retain all rights not expressly granted(?: \\S+){0,6}"),
    ("json", "the software shall be used for good not evil"),
    ("x11", "except as contained in this notice the names? of(?: the)?(?: \\S+){1,6} shall not be used in advertising or otherwise to promote the sale"),
    ("x11", "except as contained in this notice(?: \\S+){1,16} shall not be used in advertising(?: \\S+){0,24} authorization"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("wtfpl", "you just do what the fuck you want to(?: public licen[cs]e)?"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff(?: \\S+){0,20} buy me a beer(?: in return)?"),
    ("openssl", "this product includes software developed by the openssl project(?: for use in the openssl toolkit)?"),
    ("nasa", "nasa open source agreement(?: version \\d(?: \\d)?)?"),
    ("apache", "subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you"),
    ("apache", "you must give any other recipients of the work or derivative works a copy of this licen[cs]e"),
    ("apache", "if the work includes a notice text file as part of its distribution"),
    ("apache", "licen[cs]ed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache-1-1", "products derived from this software may not be called apache nor may apache appear in their name"),
    ("bsd", "in no event shall the(?: copyright (?:holders?|owners?) (?:or|and) contributors| regents or contributors| author) be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-2-clause-patent", "each copyright holder and contributor hereby grants to those receiving rights under this licen[cs]e a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("bsd-3-clause-clear", "no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("pil", "by obtaining using and or copying this software and or its associated documentation you agree that you have read understood and will comply with the following terms"),
    ("isc", "the software is provided as is and (?:isc|the author|internet systems consortium) disclaims all warranties with regard to this software"),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies"),
    ("libtiff", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee provided that i the above copyright notices"),
    ("tcl", "the authors hereby grant permission to use copy modify distribute and licen[cs]e this software and its documentation for any purpose"),
    ("icu", "provided that the above copyright notice s and this permission notice appear in all copies of the software"),
    ("gpl", "when we speak of free software we are referring to freedom not price"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("gpl", "you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("gpl-2.0", "you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program"),
    ("gpl-2.0", "if the modified program normally reads commands interactively when run you must cause it"),
    ("gpl-2.0", "each time you redistribute the program or any work based on the program the recipient automatically receives a licen[cs]e from the original licensor"),
    ("gpl-3.0", "to convey a work means any kind of propagation that enables other parties to make or receive copies"),
    ("gpl-3.0", "a user product is either 1 a consumer product which means any tangible personal property"),
    ("gpl-3.0", "installation information for a user product means any methods procedures authorization keys"),
    ("classpath-exception", "linking this library statically or dynamically with other modules is making a combined work based on this library"),
    ("classpath-exception", "as a special exception the copyright holders? of this library gives? you permission to link this library with independent modules"),
    ("gcc-exception", "gcc runtime library exception"),
    ("openssl-exception", "as a special exception the copyright holders? gives? permission to link the code of portions of this program with the openssl library"),
    ("bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("autoconf-exception", "if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("font-exception", "if you create a document which uses this font and embed this font or unaltered portions of this font into the document"),
    ("llvm-exception", "as an exception if as a result of your compiling your source code portions of this software are embedded into an object form"),
    ("lgpl", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:library|program)"),
    ("lgpl", "when a work that uses the library uses material from a header file that is part of the library"),
    ("lgpl-3.0", "this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e"),
    ("lgpl-3.0", "a combined work is a work produced by combining or linking an application with the library"),
    ("agpl", "you should have received a copy of the gnu affero general public licen[cs]e along with this program"),
    ("agpl", "remote network interaction use with the gnu general public licen[cs]e"),
    ("mpl", "if it is not possible or desirable to put the notice in a particular file then you may include the notice in a location"),
    ("mpl", "each contributor hereby grants you a world wide royalty free non exclusive licen[cs]e under intellectual property rights"),
    ("mpl-2.0", "covered software is provided under this licen[cs]e on an as is basis without warranty of any kind"),
    ("mpl-2.0", "this source code form is incompatible with secondary licen[cs]es as defined by the mozilla public licen[cs]e"),
    ("epl", "a contribution originates from a contributor if it was added to the program by such contributor itself or anyone acting on such contributor s behalf"),
    ("epl", "in the case of each subsequent contributor i changes to the program and ii additions to the program"),
    ("edl", "made available under the terms of the eclipse distribution licen[cs]e"),
    ("cpl", "made available under the terms of the common public licen[cs]e"),
    ("ipl", "the accompanying program is provided under the terms of this ibm public licen[cs]e"),
    ("cddl", "the contents of this file are subject to the terms of either the gnu general public licen[cs]e version 2 only gpl or the common development and distribution licen[cs]e"),
    ("eupl", "the work is a work in progress which is continuously improved by numerous contributors"),
    ("ms-pl", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software your patent licen[cs]e from such contributor to the software ends automatically"),
    ("bsl", "the copyright notices in the software and this entire statement including the above licen[cs]e grant this restriction and the following disclaimer must be included in all copies"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "this notice may not be removed or altered from any source distribution"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"),
    ("unlicense", "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc", "creative commons corporation is not a law firm and does not provide legal services"),
    ("cc", "the licensor cannot revoke these freedoms as long as you follow the licen[cs]e terms"),
    ("cc-by", "you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e as the original"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2.0", "this licen[cs]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("psf", "subject to the terms and conditions of this licen[cs]e agreement psf hereby grants licensee a nonexclusive royalty free world wide licen[cs]e"),
    ("python", "beopen com is making this software available to licensee on an as is basis"),
    ("python", "cnri is making python 1 6(?: 1| b1)? available to licensee on an as is basis"),
    ("openssl", "the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software"),
    ("ssleay", "this package is an ssl implementation written by eric young"),
    ("ssleay", "the implementation was written so as to conform with netscapes ssl"),
    ("ofl", "the fonts and derivatives however cannot be released under any other type of licen[cs]e"),
    ("ofl", "neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ncsa", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers"),
    ("w3c", "the full text of this notice in a location viewable to users of the redistributed or derivative work"),
    ("unicode", "unicode inc licen[cs]e agreement data files and software"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim except that they must include this licen[cs]e text"),
    ("lppl", "the latex project public licen[cs]e lppl is the primary licen[cs]e under which the latex kernel and the base latex packages are distributed"),
    ("ruby", "you may make and give away verbatim copies of the source form of the software without restriction"),
    ("ruby", "place your modifications in the public domain or otherwise make them freely available such as by posting said modifications to usenet"),
    ("php", "redistributions of any form whatsoever must retain the following acknowledge?ment this product includes php software"),
    ("php", "the name php must not be used to endorse or promote products derived from this software"),
    ("cecill-b", "the exercising of this freedom is conditional upon a strong obligation of giving credits for everybody that distributes a software"),
    ("osl", "the term external deployment means the use distribution or communication of the original work"),
    ("osl", "licensor hereby grants you a world ?wide royalty free non exclusive sublicen[cs]able licen[cs]e for the duration of the copyright"),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licen[cs]ed work"),
    ("elastic", "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "the grant of rights under the licen[cs]e will not include and the licen[cs]e does not grant to you the right to sell the software"),
    ("polyform", "any noncommercial purpose is a permitted purpose"),
    ("gfdl", "the purpose of this licen[cs]e is to make a manual textbook or other functional and useful document free in the sense of freedom"),
    ("odbl", "is made available under the open database licen[cs]e"),
    ("blueoak", "blue oak model licen[cs]e"),
    ("blueoak", "each contributor licen[cs]es you to do everything with this software that would otherwise infringe that contributor s copyright in it"),
    ("mulan", "mulan (?:permissive software licen[cs]e|psl)(?: v2)?"),
    ("upl", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("ecl", "educational community licen[cs]e(?: version)?(?: [12] 0)?"),
    ("apsl", "this file contains original code and or modifications of original code as defined in and that are subject to the apple public source licen[cs]e"),
    ("sgi-b", "sgi free software licen[cs]e b(?: version)?(?: \\d \\d)?"),
    ("qpl", "may be distributed under the terms of the q public licen[cs]e"),
    ("llama", "llama(?: \\S+){0,3} community licen[cs]e agreement"),
    ("openrail", "open ?rail(?: m| s)? licen[cs]e"),
    ("openrail", "you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law"),
    ("gemma", "gemma is provided under and subject to the gemma terms of use"),
    ("nvidia", "nvidia corporation and its licensors retain all intellectual property and proprietary rights in and to this software"),
    ("oracle", "oracle binary code licen[cs]e agreement"),
    ("proprietary", "this software is the confidential and proprietary information of(?: \\S+){1,8}"),
    ("proprietary", "all information contained herein is and remains the property of"),
    ("proprietary", "end user licen[cs]e agreement"),
    ("proprietary", "reverse engineer decompile or disassemble(?: the software)?"),
    ("proprietary", "the software is licen[cs]ed not sold"),
    ("fair", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("miros", "permission is granted to deal in this work without restriction including unlimited rights to use publicly perform distribute sell modify merge give away or sublicence"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code for the(?: db)? software"),
    ("info-zip", "redistributions in binary form compiled executables(?: and libraries)? must reproduce the above copyright notice definition disclaimer"),
    ("blessing", "may you do good and not evil may you find forgiveness for yourself and forgive others may you share freely never taking more than you give"),
    ("gnuplot", "permission to modify the software is granted but not the right to distribute the complete modified source code"),
    ("zpl", "zope public licen[cs]e(?: zpl)?(?: version \\d \\d)?"),
)
#: Signatures of addresses under which licenses stand: label, pattern.
PLACES = (
    ("apache", "apache org licen[cs]es licen[cs]e 2 0"),
    ("apache", "apache org licen[cs]es licen[cs]e 1 1"),
    ("gpl", "gnu org licen[cs]es(?: old licen[cs]es)? gpl(?: [123] 0)?"),
    ("lgpl", "gnu org licen[cs]es(?: old licen[cs]es)? lgpl(?: [23] [01])?"),
    ("agpl", "gnu org licen[cs]es agpl(?: 3 0)?"),
    ("gfdl", "gnu org licen[cs]es fdl(?: 1 [123])?"),
    ("gpl", "gnu org copyleft gpl(?: html)?(?: licen[cs]e)?"),
    ("cc-by", "creativecommons org licen[cs]es by [1234] [05]"),
    ("cc-by-sa", "creativecommons org licen[cs]es by sa [1234] [05]"),
    ("cc-by-nc", "creativecommons org licen[cs]es by nc [1234] [05]"),
    ("cc-by-nd", "creativecommons org licen[cs]es by nd [1234] [05]"),
    ("cc-by-nc-sa", "creativecommons org licen[cs]es by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "creativecommons org licen[cs]es by nc nd [1234] [05]"),
    ("cc0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"),
    ("bsl", "boost org licen[cs]e 1 0(?: txt)?"),
    ("unlicense", "unlicense org"),
    ("mit", "opensource org licen[cs]es mit(?: licen[cs]e)?(?: php)?"),
    ("bsd", "opensource org licen[cs]es bsd(?: [0234] clause| licen[cs]e)?(?: php)?"),
    ("zlib", "(?:www )?zlib net zlib licen[cs]e(?: html)?"),
    ("cddl", "(?:sun com|java net|opensource org licen[cs]es) cddl(?: licen[cs]e)?(?: 1 [01])?"),
    ("psf", "(?:docs )?python org(?: psf| \\d)? (?:psf )?licen[cs]e(?: html)?"),
    ("artistic", "dev perl org licen[cs]es(?: artistic)?(?: html)?"),
    ("eupl", "joinup ec europa eu(?: \\S+){0,6} eupl"),
    ("mpl", "mozilla org mpl(?: [12] [01])?"),
    ("epl", "eclipse org legal epl(?: v10| 2 0| v20)?"),
    ("wtfpl", "wtfpl net"),
    ("ofl", "scripts sil org ofl"),
    ("ofl", "openfontlicense org"),
    ("isc", "opensource org licen[cs]es isc(?: licen[cs]e)?(?: txt)?"),
    ("artistic", "opensource org licen[cs]es artistic(?: licen[cs]e)?(?: \\d \\d)?"),
    ("elastic", "elastic co licensing elastic licen[cs]e"),
    ("mpl", "opensource org licen[cs]es mpl(?: \\d \\d)?"),
    ("lppl", "latex project org lppl(?: txt)?"),
    ("odbl", "opendatacommons org licen[cs]es odbl"),
    ("pddl", "opendatacommons org licen[cs]es pddl"),
    ("odc-by", "opendatacommons org licen[cs]es by"),
)

#: Licenses by name: label, the name as words before "license", and the identifier as words.
LICENSES = (
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("apache", "apache(?: software)?", "apache(?: 2 0| 1 1)?"),
    ("gpl", "(?:gnu )?general public", "gpl(?: [123] 0| [123])?(?: only| or later)?"),
    ("gpl", "gpl(?: v[123]| [123])?", "gplv?[123]?"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "lgpl(?: [23] [01])?(?: only| or later)?"),
    ("lgpl", "lgpl(?: v[23]| [23])?", "lgplv?[23]?"),
    ("agpl", "(?:gnu )?affero general public", "agpl(?: 3 0)?(?: only| or later)?"),
    ("agpl", "agpl(?: v3| 3)?", "agplv?3?"),
    ("bsd", "(?:new |revised |simplified |modified |original )?bsd(?: style)?", "bsd(?: [0234] clause)?"),
    ("bsd", "[0234] clause bsd", "0bsd"),
    ("mpl", "mozilla public", "mozilla"),
    ("mpl", "mpl(?: [12] [01])?", "mpl(?: [12] [01])?"),
    ("epl", "eclipse public", "epl(?: [12] 0)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib(?: libpng)?", "zlib"),
    ("bsl", "boost software", "bsl(?: 1 0)?"),
    ("artistic", "(?:perl )?artistic", "artistic(?: [12] 0)?"),
    ("cc-by", "creative commons attribution", "cc by(?: [1234] [05])?"),
    ("cc-by-sa", "creative commons attribution share ?alike", "cc by sa(?: [1234] [05])?"),
    ("cc-by-nc", "creative commons attribution non ?commercial", "cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s", "cc by nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike", "cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s", "cc by nc nd(?: [1234] [05])?"),
    ("cc0", "creative commons zero(?: public domain)?", "cc0(?: 1 0)?"),
    ("cc", "creative commons", "cc"),
    ("unlicense", "public domain", "unlicense"),
    ("wtfpl", "do what the fuck you want to public", "wtfpl"),
    ("psf", "python software foundation", "psf(?: 2 0)?"),
    ("python", "python", "python(?: 2 0)?"),
    ("afl", "academic free", "afl(?: [123] [012])?"),
    ("osl", "open software", "osl(?: [123] [01])?"),
    ("cpl", "common public", "cpl(?: 1 0)?"),
    ("cpal", "common public attribution", "cpal(?: 1 0)?"),
    ("cddl", "common development and distribution", "cddl(?: 1 [01])?"),
    ("ms-pl", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft reciprocal", "ms rl"),
    ("eupl", "european union public", "eupl(?: 1 [012])?"),
    ("cecill", "cecill(?: free software)?", "cecill(?: [12] [01])?"),
    ("ofl", "(?:sil )?open font", "ofl(?: 1 [01])?"),
    ("postgresql", "postgresql", "postgresql"),
    ("ruby", "ruby", "ruby"),
    ("php", "php", "php(?: 3 01?)?"),
    ("openssl", "openssl", "openssl"),
    ("json", "json", "json"),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    ("w3c", "w3c(?: software)?", "w3c"),
    ("x11", "x11", "x11"),
    ("vim", "vim", "vim"),
    ("curl", "curl", "curl"),
    ("unicode", "unicode(?: data files and software)?", "unicode"),
    ("lppl", "latex project public", "lppl(?: 1 3[ac]?)?"),
    ("rpl", "reciprocal public", "rpl(?: 1 [15])?"),
    ("qpl", "q public", "qpl(?: 1 0)?"),
    ("upl", "universal permissive", "upl(?: 1 0)?"),
)
VERSION = r"(?: version \d+(?: \d+)*| v\d+(?: \d+)*| \d+(?: \d+)*)?"
#: Forms in which names stand: whether they name a license by its identifier, priority, score, and the pattern around it.
FORMS = (
    ("id", 5, 1.0, "spdx license identifier {}"),
    ("name", 4, 0.95, "(?:licensed|released|distributed|available|provided|published|covered) (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?{} licen[cs]e" + VERSION),
    ("id", 3, 0.9, "(?:opensource|spdx|choosealicense) (?:org|com) licen[cs]es? {}"),
    ("name", 3, 0.8, "(?:the |an? ){} licen[cs]e" + VERSION),
    ("id", 2, 0.7, "licen[cs]e[sd]? (?:is |are |as |type |name |under )?(?:the )?{}"),
    ("name", 1, 0.6, "{} licen[cs]e[sd]?" + VERSION),
)


def spaced(pattern: str) -> str:
    """The pattern for words between which two blanks stand, so that neighbouring matches need not share one."""
    inner = pattern.replace(" ?", "\x00").replace(" ", "  ").replace("\x00", "(?:  )?")
    return f" {inner} "


def rules() -> list[tuple[str, int, float, str]]:
    """Label, priority, score and pattern of every rule: bodies first, then addresses, then each name in each form."""
    out = [(label, 7, 1.0, pattern) for label, pattern in BODIES]
    out += [(label, 6, 0.95, pattern) for label, pattern in PLACES]
    return out + [(label, priority, score, around.format(identifier if form == "id" else name)) for form, priority, score, around in FORMS for label, name, identifier in LICENSES]


def spelled(token: str) -> list[str] | None:
    """The words that a pattern's token without groups stands for; None if they aren't a short list."""
    out, at = [""], 0
    while at < len(token):
        if token[at] == "[":
            end = token.index("]", at)
            letters, at = list(token[at + 1 : end]), end + 1
        elif token[at].isalnum():
            letters, at = [token[at]], at + 1
        else:
            return None
        if token[at : at + 1] == "?":
            letters, at = [*letters, ""], at + 1
        out = [o + letter for o in out for letter in letters]
    return out if len(out) <= 12 and all(out) else None


def needed(pattern: str) -> list[list[str]]:
    """Lists of words, of each of which one stands in whatever the pattern matches: its words outside groups, the longest first."""
    flat, depth, begin = "", 0, 0
    # What says how often a group stands belongs to the group.
    pattern = re.sub(r"\)(?:\?|\{\d+,\d+\})", ")", pattern)
    for at, c in enumerate(pattern):
        if c == "(":
            begin, depth = (at if not depth else begin), depth + 1
        elif c == ")":
            depth -= 1
            if not depth:
                # A group that brings its own blank leaves the word beside it whole; any other is a part of that word.
                inner = pattern[begin + 3 : at].split("|")
                flat += " \0" if all(i.startswith(" ") for i in inner) else "\0 " if all(i.endswith(" ") for i in inner) else "\0"
        elif not depth:
            flat += c
    tokens = flat.split(" ")
    # Before an optional blank, and after it, a word may go on.
    loose = {k + d for k, t in enumerate(tokens) if t.startswith("?") for d in (-1, 0)}
    found = [words for k, t in enumerate(tokens) if k not in loose and t and (words := spelled(t))]
    return sorted(found, key=lambda words: (-min(map(len, words)), words))


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def base_columns(words: Column) -> dict[str, Column]:
    """Places of the base phrases among the words, and their labels."""

    def stands(phrase: str, i: Column) -> Column:
        found = F.lit(True)
        for k, word in enumerate(phrase.split(" ")):
            found = found & F.coalesce(F.get(words, i + k) == word, F.lit(False))
        return found

    def anywhere(i: Column) -> Column:
        out = F.lit(False)
        for phrase, _ in PHRASES:
            out = out | stands(phrase, i)
        return out

    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), anywhere)
    labels = F.array_compact(F.array(*[F.when(F.exists(F.col("places"), partial(stands, phrase)), F.lit(label)) for phrase, label in PHRASES]))
    return {"places": places, "base": F.array_sort(labels)}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with n_words, places, base (labels), found (labels of the rules that stay) and rule_score, which replace columns of these names."""
    added = ("n_words", "places", "base", "found", "rule_score")
    kept = unboxed([c for c in docs.columns if c.lower() != text.lower()], text, *added)
    seen = boxed(docs, text, *added)
    none = F.array().cast("array<string>")
    made = rules()
    keywords = [needed(pattern)[:KEYWORDS] for *_, pattern in made]
    # Letters beyond A-Z are lowered too here, which makes no word of two and may only let more rules be tried.
    rough = seen.select("box", "text", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(SPARK_WORD), F.lit(0)).alias("rough"))
    every = sorted({word for lists in keywords for words in lists for word in words} | {BASE_WORD})
    rough = rough.select("box", "text", F.size("rough").cast("long").alias("n_words"), F.array_intersect("rough", F.lit(every)).alias("said"))

    # Long lists of expressions are put as SQL, which is read at once; built column by column they take longer than the scan of a small table.
    holds = lambda words: "(" + " OR ".join(f"array_contains(said, '{word}')" for word in words) + ")"
    may = ", ".join(f"CASE WHEN {' AND '.join(map(holds, lists))} THEN {k} END" for k, lists in enumerate(keywords))
    rough = rough.withColumn("tried", F.expr(f"CASE WHEN size(said) > 0 THEN array_compact(array({may})) ELSE CAST(array() AS array<int>) END"))
    rough = rough.withColumn("held", (F.size("tried") > 0) | F.array_contains("said", BASE_WORD))
    # Texts within ASCII are lowered at once; the translation of letter by letter takes much longer.
    plain_text = F.octet_length("text") == F.char_length("text")
    exact = F.when(plain_text, F.lower("text")).otherwise(lowered(F.col("text")))
    once = staged(rough.select("box", "n_words", "tried", F.when(F.col("held"), F.regexp_extract_all(exact, F.lit(SPARK_WORD), F.lit(0))).alias("words")), "license-words")
    plain = once.filter("words is null").select(*kept, "n_words", F.array().cast("array<int>").alias("places"), none.alias("base"), none.alias("found"), F.lit(0.0).alias("rule_score"))
    held = once.filter("words is not null").select("box", "words", "tried")
    base = base_columns(F.col("words"))
    held = held.withColumn("places", base["places"]).withColumn("base", base["base"])
    joined = F.concat(F.lit("  "), F.array_join("words", "  "), F.lit("  "))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.select("box", F.size("words").cast("long").alias("n_words"), "places", "base", "tried", joined.alias("joined")).repartition(spread)
    held = staged(held.withColumn("row", F.monotonically_increasing_id()), "licenses")

    # Patterns are literals, so each is compiled once, and each is tried only where its keywords stand.
    patterns = [spaced(pattern) for *_, pattern in made]
    hits = ", ".join(f"struct({k} AS rule, CASE WHEN array_contains(tried, {k}) THEN regexp_extract_all(joined, r'{pattern}', 0) END AS hits)" for k, pattern in enumerate(patterns))
    matched = held.filter(F.size("tried") > 0).select("row", "joined", F.explode(F.expr(f"filter(array({hits}), r -> size(r.hits) > 0)")).alias("m")).select("row", "joined", "m.rule", "m.hits")
    of = F.expr("array({})".format(", ".join(f"struct('{label}' AS label, {priority} AS priority, {score}D AS score, r'{pattern}' AS pattern)" for (label, priority, score, _), pattern in zip(made, patterns))))
    matched = matched.withColumn("of", F.get(of, F.col("rule")))
    gaps = F.transform(F.split("joined", F.col("of.pattern")), lambda part: F.length(part))
    zipped = F.arrays_zip(F.transform("hits", lambda h: F.length(h)).alias("size"), F.slice(gaps, F.lit(1), F.size("hits")).alias("gap"))
    each = matched.select("row", "rule", "of.label", "of.priority", "of.score", F.posexplode(zipped).alias("i", "hit"))
    order = W.partitionBy("row", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("hit.gap") + F.col("hit.size")).over(order)
    detections = each.select("row", "label", "priority", "score", (end - F.col("hit.size")).alias("start"), end.alias("end"))
    so_far = W.partitionBy("row").orderBy("start").rangeBetween(W.unboundedPreceding, 0)
    contained = F.lit(False)
    for level in sorted({priority for _, priority, _, _ in made}):
        higher = F.max(F.when(F.col("priority") > level, F.col("end"))).over(so_far)
        contained = contained | ((F.col("priority") == level) & F.coalesce(higher >= F.col("end"), F.lit(False)))
    # Of equal priority, a detection strictly within a longer one goes: it begins later and ends no later, or begins there and ends earlier.
    level_so_far = W.partitionBy("row", "priority").orderBy("start").rangeBetween(W.unboundedPreceding, -1)
    contained = contained | F.coalesce(F.max("end").over(level_so_far) >= F.col("end"), F.lit(False))
    contained = contained | (F.max("end").over(W.partitionBy("row", "priority", "start")) > F.col("end"))
    stay = detections.withColumn("contained", contained).filter(~F.col("contained"))
    per_row = stay.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("rule_score"))
    gated = held.join(per_row, "row", "left").select(*kept, "n_words", "places", "base", F.coalesce("found", none).alias("found"), F.coalesce("rule_score", F.lit(0.0)).alias("rule_score"))
    return plain.unionByName(gated)


def op9(docs: DataFrame) -> DataFrame:
    """Base counts, labels and score of each document."""
    found = scan(docs.select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.col("rule_score")).alias("score"),
    )


def oracle() -> str:
    """DuckDB SQL for ``op9``: a rule is tried wherever the letters stand with which its longest word begins."""
    begins = [commonprefix(needed(pattern)[0]) for *_, pattern in rules()]
    values = ", ".join("({}, '{}', '{}', {}, {}, '{}')".format(k, label, begin, priority, score, spaced(pattern)) for k, ((label, priority, score, pattern), begin) in enumerate(zip(rules(), begins)))
    places = " OR ".join("(" + " AND ".join(f"w[p + {k}] = '{word}'" for k, word in enumerate(phrase.split(" "), 1)) + ")" for phrase, _ in PHRASES)
    labels = ", ".join("bool_or({}) AS is_{}".format(" AND ".join(f"w[p + {k}] = '{word}'" for k, word in enumerate(phrase.split(" "), 1)), label) for phrase, label in PHRASES)
    base = "list_sort(list_filter([{}], lambda x: x IS NOT NULL))".format(", ".join(f"CASE WHEN is_{label} THEN '{label}' END" for _, label in PHRASES))
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), j AS (SELECT doc_id, '  ' || array_to_string(w, '  ') || '  ' AS t FROM d WHERE len(w) > 0),
rules(rule, label, begins, priority, score, pattern) AS (VALUES {values}),
tried AS (SELECT doc_id, rule, label, priority, CAST(score AS DOUBLE) AS score, pattern, regexp_extract_all(t, pattern) AS hits, string_split_regex(t, pattern) AS gaps FROM j JOIN rules ON contains(t, begins) WHERE regexp_matches(t, pattern)),
each AS (SELECT doc_id, rule, label, priority, score, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM tried),
ends AS (SELECT doc_id, label, priority, score, length(hits[i]) AS size, sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY doc_id, rule ORDER BY i) AS e FROM each),
det AS (SELECT doc_id, label, priority, score, e - size AS s, e FROM ends),
stay AS (SELECT * FROM det a WHERE NOT EXISTS (SELECT 1 FROM det b WHERE b.doc_id = a.doc_id AND b.s <= a.s AND b.e >= a.e AND (b.priority > a.priority OR (b.priority = a.priority AND b.e - b.s > a.e - a.s)))),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM stay GROUP BY doc_id),
pl AS (SELECT doc_id, w, p FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d) WHERE {places}),
base AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS b, {labels} FROM pl GROUP BY doc_id),
named AS (SELECT doc_id, n, a, b, {base} AS labels FROM base)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
  coalesce(array_to_string(named.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(named.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
  greatest(CASE WHEN n > 0 THEN 0.5 ELSE 0.0 END, coalesce(found.score, 0.0)) AS score
FROM d LEFT JOIN named USING (doc_id) LEFT JOIN found USING (doc_id)
"""

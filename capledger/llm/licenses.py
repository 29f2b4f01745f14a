"""License scans by ordered signature rules: several hundred expressions, each tried only on texts in which the keyword automaton meets one of its keywords; priority, then containment, decides between detections that overlap."""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.spans import lowered

_V = r"(?:[,;:]?\s+\(?(?:version|v\.?|ver\.?)?\s*|[\s-]?v?)"
_GNU = r"(?:the\s+)?(?:gnu\s+)?"
_LATER = r"\)?[,;]?[\s-]*(?:\(?\s*(?:or|and)[\s-]+(?:\(?at\s+your\s+option\)?\s+)?(?:any\s+)?(?:later|newer)(?:\s+versions?)?\)?|\+)"

#: Identifier, keywords of which a text must hold one, expression of the name, expression of its address (or "").
NAMES: tuple[tuple[str, str, str, str], ...] = (
    ("MIT", "mit", r"(?:the\s+)?(?:mit|expat)(?:/x11)?[\s-]+licen[cs]e", r"opensource\.org/licenses?/mit(?:-license(?:\.php)?)?"),
    ("MIT-0", "mit", r"mit(?:-0|\s+no\s+attribution)(?:\s+licen[cs]e)?", r"opensource\.org/licenses?/mit-0"),
    ("Apache-1.0", "apache", r"apache(?:\s+software)?\s+licen[cs]e" + _V + r"1\.0(?!\.?\d)", ""),
    ("Apache-1.1", "apache", r"apache(?:\s+software)?\s+licen[cs]e" + _V + r"1\.1(?!\.?\d)", r"apache\.org/licenses/license-1\.1"),
    ("Apache-2.0", "apache asl", r"(?:apache(?:\s+software)?(?:[\s-]+licen[cs]e)?" + _V + r"(?:2\.0|(?<!apache)2)(?!\.?\d)(?:\s+licen[cs]e)?|asl\s*2(?:\.0)?)", r"apache\.org/licenses/license-2\.0"),
    ("GPL-1.0-only", "gpl general", _GNU + r"(?:gpl|general\s+public\s+licen[cs]e)" + _V + r"1(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"),
    ("GPL-2.0-only", "gpl general", _GNU + r"(?:gpl|general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)2(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("GPL-2.0-or-later", "gpl general", _GNU + r"(?:gpl|general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)2(?:\.0)?" + _LATER, ""),
    ("GPL-3.0-only", "gpl general", _GNU + r"(?:gpl|general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/gpl-3\.0"),
    ("GPL-3.0-or-later", "gpl general", _GNU + r"(?:gpl|general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)3(?:\.0)?" + _LATER, ""),
    ("LGPL-2.0-only", "lgpl library", _GNU + r"(?:lgpl|library\s+general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)2(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("LGPL-2.1-only", "lgpl lesser", _GNU + r"(?:lgpl|lesser\s+general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)2\.1(?!\.?\d)", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("LGPL-2.1-or-later", "lgpl lesser", _GNU + r"(?:lgpl|lesser\s+general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)2\.1" + _LATER, ""),
    ("LGPL-3.0-only", "lgpl lesser", _GNU + r"(?:lgpl|lesser\s+general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/lgpl-3\.0"),
    ("LGPL-3.0-or-later", "lgpl lesser", _GNU + r"(?:lgpl|lesser\s+general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)3(?:\.0)?" + _LATER, ""),
    ("AGPL-1.0-only", "agpl affero", r"(?:the\s+)?(?:agpl|affero\s+general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)1(?:\.0)?(?!\.?\d)", ""),
    ("AGPL-3.0-only", "agpl affero", _GNU + r"(?:agpl|affero\s+general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)3(?:\.0)?(?!\.?\d)", r"gnu\.org/licenses/agpl-3\.0"),
    ("AGPL-3.0-or-later", "agpl affero", _GNU + r"(?:agpl|affero\s+general\s+public\s+licen[cs]e)(?:" + _V + r"|[\s-]?v)3(?:\.0)?" + _LATER, ""),
    ("GFDL-1.1-only", "gfdl documentation", _GNU + r"(?:gfdl|free\s+documentation\s+licen[cs]e)" + _V + r"1\.1(?!\.?\d)", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.1"),
    ("GFDL-1.2-only", "gfdl documentation", _GNU + r"(?:gfdl|free\s+documentation\s+licen[cs]e)" + _V + r"1\.2(?!\.?\d)", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    ("GFDL-1.3-only", "gfdl documentation", _GNU + r"(?:gfdl|free\s+documentation\s+licen[cs]e)" + _V + r"1\.3(?!\.?\d)", r"gnu\.org/licenses/fdl-1\.3"),
    ("BSD-1-Clause", "bsd", r"(?:bsd[\s-]+(?:1|one)[\s-]+clause|(?:1|one)[\s-]+clause\s+bsd)(?:\s+licen[cs]e)?", r"opensource\.org/licenses?/bsd-1-clause"),
    ("BSD-2-Clause", "bsd", r"(?:bsd[\s-]+(?:2|two)[\s-]+clause|(?:2|two)[\s-]+clause\s+bsd|simplified\s+bsd|freebsd)(?:\s+licen[cs]e)", r"opensource\.org/licenses?/bsd-2-clause"),
    ("BSD-3-Clause", "bsd", r"(?:bsd[\s-]+(?:3|three)[\s-]+clause|(?:3|three)[\s-]+clause\s+bsd|(?:new|modified|revised)\s+bsd)(?:\s+licen[cs]e)?", r"opensource\.org/licenses?/bsd-3-clause"),
    ("BSD-3-Clause-Clear", "bsd", r"(?:the\s+)?clear\s+bsd\s+licen[cs]e", ""),
    ("BSD-4-Clause", "bsd", r"(?:bsd[\s-]+(?:4|four)[\s-]+clause|(?:4|four)[\s-]+clause\s+bsd|original\s+bsd)(?:\s+licen[cs]e)?", ""),
    ("0BSD", "bsd", r"(?:0bsd|zero[\s-]+clause\s+bsd|bsd\s+zero[\s-]+clause)(?:\s+licen[cs]e)?", r"opensource\.org/licenses?/0bsd"),
    ("ISC", "isc", r"(?:the\s+)?isc\s+licen[cs]e", r"opensource\.org/licenses?/isc(?:-license)?"),
    ("MPL-1.0", "mozilla mpl", r"(?:mozilla\s+public\s+licen[cs]e|mpl)(?:" + _V + r"|[\s-]?v?)1\.0(?!\.?\d)", r"mozilla\.org/mpl/1\.0|mozilla\.org/mpl/mpl-1\.0"),
    ("MPL-1.1", "mozilla mpl", r"(?:mozilla\s+public\s+licen[cs]e|mpl)(?:" + _V + r"|[\s-]?v?)1\.1(?!\.?\d)", r"mozilla\.org/mpl/(?:mpl-)?1\.1"),
    ("MPL-2.0", "mozilla mpl", r"(?:mozilla\s+public\s+licen[cs]e|mpl)(?:" + _V + r"|[\s-]?v?)2(?:\.0)?(?!\.?\d)", r"mozilla\.org/(?:[a-z-]+/)?mpl/2\.0"),
    ("EPL-1.0", "eclipse epl", r"(?:eclipse\s+public\s+licen[cs]e|epl)(?:" + _V + r"|[\s-]?v?)1(?:\.0)?(?!\.?\d)", r"eclipse\.org/legal/epl-v10"),
    ("EPL-2.0", "eclipse epl", r"(?:eclipse\s+public\s+licen[cs]e|epl)(?:" + _V + r"|[\s-]?v?)2(?:\.0)?(?!\.?\d)", r"eclipse\.org/legal/epl-(?:v20|2\.0)"),
    ("EUPL-1.1", "european eupl", r"(?:european\s+union\s+public\s+licen[cs]e|eupl)(?:" + _V + r"|[\s-]?v?)1\.1(?!\.?\d)", ""),
    ("EUPL-1.2", "european eupl", r"(?:european\s+union\s+public\s+licen[cs]e|eupl)(?:" + _V + r"|[\s-]?v?)1\.2(?!\.?\d)", r"joinup\.ec\.europa\.eu/[a-z/-]*eupl"),
    ("CDDL-1.0", "cddl distribution", r"(?:common\s+development\s+and\s+distribution\s+licen[cs]e|cddl)(?:" + _V + r"|[\s-]?v?)1\.0(?!\.?\d)", r"opensource\.org/licenses?/cddl-?1(?:\.0)?"),
    ("CDDL-1.1", "cddl distribution", r"(?:common\s+development\s+and\s+distribution\s+licen[cs]e|cddl)(?:" + _V + r"|[\s-]?v?)1\.1(?!\.?\d)", ""),
    ("CPL-1.0", "common", r"common\s+public\s+licen[cs]e(?:" + _V + r"1\.0)?", r"opensource\.org/licenses?/cpl1\.0"),
    ("Artistic-1.0", "artistic", r"artistic\s+licen[cs]e" + _V + r"1(?:\.0)?(?!\.?\d)", r"opensource\.org/licenses?/artistic-(?:license-)?1\.0"),
    ("Artistic-2.0", "artistic", r"artistic\s+licen[cs]e" + _V + r"2(?:\.0)?(?!\.?\d)", r"opensource\.org/licenses?/artistic-(?:license-)?2\.0"),
    ("BSL-1.0", "boost", r"boost\s+software\s+licen[cs]e(?:" + _V + r"1\.0)?", r"boost\.org/license_1_0"),
    ("BUSL-1.1", "business busl", r"business\s+source\s+licen[cs]e(?:" + _V + r"1\.1)?", r"mariadb\.com/bsl11"),
    ("SSPL-1.0", "sspl server", r"(?:server\s+side\s+public\s+licen[cs]e|sspl)(?:" + _V + r"1(?:\.0)?)?", ""),
    ("Elastic-2.0", "elastic", r"elastic\s+licen[cs]e" + _V + r"2(?:\.0)?", r"elastic\.co/licensing/elastic-license"),
    ("Unlicense", "unlicense", r"(?:the\s+)?unlicense", r"unlicense\.org"),
    ("WTFPL", "wtfpl want", r"(?:wtfpl|do\s+what\s+the\s+f\S{2,4}\s+you\s+want\s+to\s+public\s+licen[cs]e)", r"wtfpl\.net"),
    ("Zlib", "zlib", r"zlib(?:/libpng)?\s+licen[cs]e", r"opensource\.org/licenses?/zlib(?:-license)?"),
    ("libpng-2.0", "libpng", r"png\s+reference\s+library\s+licen[cs]e|libpng\s+licen[cs]e", ""),
    ("PostgreSQL", "postgresql", r"postgresql\s+licen[cs]e", r"opensource\.org/licenses?/postgresql"),
    ("PSF-2.0", "python psf", r"(?:python\s+software\s+foundation\s+licen[cs]e|psf\s+licen[cs]e)(?:" + _V + r"2(?:\.0)?)?", r"docs\.python\.org/[0-9./]*license"),
    ("Python-2.0", "python", r"python\s+licen[cs]e(?:" + _V + r"2(?:\.0)?)", ""),
    ("Ruby", "ruby", r"ruby(?:'s)?\s+licen[cs]e", r"ruby-lang\.org/[a-z/]*license"),
    ("PHP-3.01", "php", r"php\s+licen[cs]e(?:" + _V + r"3\.01)?", r"php\.net/license/3_01"),
    ("OFL-1.1", "ofl font", r"(?:sil\s+)?open\s+font\s+licen[cs]e(?:" + _V + r"1\.1)?|\bofl[\s-]1\.1", r"scripts\.sil\.org/ofl|openfontlicense\.org"),
    ("CC0-1.0", "cc0 creative", r"(?:cc0|creative\s+commons\s+zero)(?:[\s-]+(?:v(?:ersion)?\s*)?1\.0)?(?:\s+universal)?", r"creativecommons\.org/publicdomain/zero/1\.0"),
    *((f"CC-{k.upper()}-{v}", "creative cc", r"(?:(?:creative\s+commons|cc)[\s-]+(?:" + r"|".join((k.replace("-", r"[\s-]"), n)) + r")(?:[\s-]+(?:licen[cs]e|public\s+licen[cs]e))?[,\s-]+(?:version\s+|v)?" + v.replace(".", r"\.") + r"(?:\s+(?:international|unported|generic))?(?:\s+licen[cs]e)?)(?!\.?\d)", r"creativecommons\.org/licenses/" + k + "/" + v.replace(".", r"\.")) for k, n in (
        ("by", r"attribution"),
        ("by-sa", r"attribution[\s-]+share-?\s?alike"),
        ("by-nd", r"attribution[\s-]+no-?\s?deriv(?:atives|s)?"),
        ("by-nc", r"attribution[\s-]+non-?\s?commercial"),
        ("by-nc-sa", r"attribution[\s-]+non-?\s?commercial[\s-]+share-?\s?alike"),
        ("by-nc-nd", r"attribution[\s-]+non-?\s?commercial[\s-]+no-?\s?deriv(?:atives|s)?"),
    ) for v in ("2.0", "2.5", "3.0", "4.0")),
    ("ODbL-1.0", "odbl database", r"(?:open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e|odbl)(?:" + _V + r"1\.0)?", r"opendatacommons\.org/licenses/odbl"),
    ("ODC-By-1.0", "odc attribution", r"(?:open\s+data\s+commons\s+attribution\s+licen[cs]e|odc-by)(?:" + _V + r"1\.0)?", r"opendatacommons\.org/licenses/by"),
    ("PDDL-1.0", "pddl domain", r"(?:public\s+domain\s+dedication\s+and\s+licen[cs]e|pddl)(?:" + _V + r"1\.0)?", r"opendatacommons\.org/licenses/pddl"),
    ("CECILL-2.1", "cecill", r"cecill(?:\s+free\s+software\s+licen[cs]e\s+agreement)?(?:" + _V + r"|-)2\.1", r"cecill\.info/licences/licence_cecill_v2\.1"),
    ("CECILL-B", "cecill", r"cecill-b(?:\s+licen[cs]e)?", r"cecill\.info/licences/licence_cecill-b"),
    ("CECILL-C", "cecill", r"cecill-c(?:\s+licen[cs]e)?", r"cecill\.info/licences/licence_cecill-c"),
    ("MulanPSL-2.0", "mulan", r"mulan\s+(?:permissive\s+software\s+licen[cs]e|psl)(?:" + _V + r"2(?:\.0)?)?", r"license\.coscl\.org\.cn/mulanpsl2"),
    ("MS-PL", "microsoft ms-pl", r"microsoft\s+public\s+licen[cs]e|\bms-pl\b", r"opensource\.org/licenses?/ms-pl"),
    ("MS-RL", "microsoft ms-rl", r"microsoft\s+reciprocal\s+licen[cs]e|\bms-rl\b", r"opensource\.org/licenses?/ms-rl"),
    ("OSL-3.0", "osl open", r"(?:open\s+software\s+licen[cs]e|osl)(?:" + _V + r"|[\s-]?v?)3\.0(?!\.?\d)", r"opensource\.org/licenses?/osl-3\.0"),
    ("AFL-3.0", "afl academic", r"(?:academic\s+free\s+licen[cs]e|afl)(?:" + _V + r"|[\s-]?v?)3\.0(?!\.?\d)", r"opensource\.org/licenses?/afl-3\.0"),
    ("QPL-1.0", "public qpl", r"q\s+public\s+licen[cs]e(?:" + _V + r"1\.0)?|\bqpl[\s-]1\.0", ""),
    ("IPL-1.0", "ibm", r"ibm\s+public\s+licen[cs]e(?:" + _V + r"1\.0)?", ""),
    ("SPL-1.0", "sun", r"sun\s+public\s+licen[cs]e(?:" + _V + r"1\.0)?", ""),
    ("NCSA", "illinois ncsa", r"(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?\s+licen[cs]e", r"opensource\.org/licenses?/(?:uoi-)?ncsa"),
    ("UPL-1.0", "universal upl", r"universal\s+permissive\s+licen[cs]e(?:" + _V + r"1\.0)?|\bupl[\s-]1\.0", r"oss\.oracle\.com/licenses/upl"),
    ("Vim", "vim", r"vim\s+licen[cs]e", ""),
    ("X11", "x11", r"x11\s+licen[cs]e", ""),
    ("Beerware", "beerware beer-ware", r"beer-?ware\s+licen[cs]e|the\s+beer-?ware", ""),
    ("BlueOak-1.0.0", "blue", r"blue\s+oak\s+model\s+licen[cs]e(?:\s+1\.0\.0)?", r"blueoakcouncil\.org/license/1\.0\.0"),
    ("OpenSSL", "openssl", r"openssl\s+licen[cs]e", r"openssl\.org/source/license"),
    ("W3C", "w3c", r"w3c\s+(?:software\s+(?:notice\s+and\s+)?)?licen[cs]e", r"w3\.org/consortium/legal"),
    ("LPPL-1.3c", "lppl latex", r"(?:latex\s+project\s+public\s+licen[cs]e|lppl)(?:" + _V + r"|[\s-]?v?)1\.3c?", r"latex-project\.org/lppl"),
    ("HPND", "historical", r"historical\s+permission\s+notice\s+and\s+disclaimer", ""),
    ("OGL-UK-3.0", "government", r"open\s+government\s+licen[cs]e(?:" + _V + r"3\.0)?", r"nationalarchives\.gov\.uk/doc/open-government-licence/version/3"),
    ("RAIL-M", "openrail rail", r"(?:creativeml\s+|bigscience\s+)?open\s*rail(?:[+-]+\+?m)?\s+licen[cs]e", ""),
)

#: Sentences of the texts themselves and wording that names no version: identifier, keywords, expression, priority.
SENTENCES: tuple[tuple[str, str, str, int], ...] = (
    ("MIT", "permission", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy", 70),
    ("ISC", "permission", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose", 70),
    ("BSD-3-Clause", "endorse", r"neither\s+the\s+names?\s+of\s+[^\n]{1,120}\s+nor\s+the\s+names\s+of\s+(?:its|their)\s+contributors\s+may\s+be\s+used\s+to\s+endorse", 70),
    ("BSD-2-Clause", "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification,\s+are\s+permitted", 60),
    ("GPL-2.0-or-later", "redistribute", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general\s+public\s+licen[cs]e", 60),
    ("Zlib", "as-is", r"this\s+software\s+is\s+provided\s+'as-is',\s+without\s+any\s+express\s+or\s+implied\s+warranty", 60),
    ("Unlicense", "unencumbered", r"free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", 70),
    ("public-domain", "domain", r"(?:dedicated|released|placed)\s+(?:in)?to\s+the\s+public\s+domain|in\s+the\s+public\s+domain", 30),
    ("GPL", "gpl general", r"(?:gnu\s+)?general\s+public\s+licen[cs]e|\bgnu\s+gpl\b", 20),
    ("LGPL", "lgpl lesser", r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e|\blgpl\b", 22),
    ("AGPL", "agpl affero", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e|\bagpl\b", 22),
    ("Apache", "apache", r"apache(?:\s+software)?\s+licen[cs]e", 20),
    ("BSD", "bsd", r"\bbsd(?:[\s-]+style)?\s+licen[cs]e", 20),
    ("CC", "creative", r"creative\s+commons(?:\s+[a-z-]+)?\s+licen[cs]e", 20),
    ("MPL", "mozilla", r"mozilla\s+public\s+licen[cs]e", 20),
    ("proprietary", "rights", r"all\s+rights\s+reserved", 10),
    ("proprietary", "confidential", r"proprietary\s+and\s+confidential", 15),
    ("copyright", "copyright", r"copyright\s+(?:\(c\)\s*|©\s*)?\d{4}(?:\s*[-–,]\s*\d{4})*", 5),
    ("MIT", "permission", r"the\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies", 72),
    ("MIT", "holders", r"in\s+no\s+event\s+shall\s+the\s+authors\s+or\s+copyright\s+holders\s+be\s+liable\s+for\s+any\s+claim,\s+damages\s+or\s+other\s+liability", 64),
    ("MIT", "noninfringement", r"merchantability,\s+fitness\s+for\s+a\s+particular\s+purpose\s+and\s+noninfringement", 62),
    ("X11", "advertising", r"except\s+as\s+contained\s+in\s+this\s+notice,\s+the\s+names?\s+of\s+[^\n]{1,120}?\s+shall\s+not\s+be\s+used\s+in\s+advertising", 72),
    ("HPND", "pertaining", r"not\s+be\s+used\s+in\s+advertising\s+or\s+publicity\s+pertaining\s+to\s+distribution\s+of\s+the\s+software", 66),
    ("ISC", "hereby", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted,\s+provided\s+that", 74),
    ("ISC", "disclaims", r"the\s+author\s+disclaims\s+all\s+warranties\s+with\s+regard\s+to\s+this\s+software", 64),
    ("0BSD", "hereby", r"distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted\.(?!\s+provided)", 68),
    ("BSD-2-Clause", "retain", r"redistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice,\s+this\s+list\s+of\s+conditions", 61),
    ("BSD-2-Clause", "reproduce", r"redistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright\s+notice", 61),
    ("BSD-4-Clause", "advertising", r"all\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software\s+must\s+display", 74),
    ("BSD-3-Clause-Clear", "patent", r"no\s+express\s+or\s+implied\s+licen[cs]es\s+to\s+any\s+party's\s+patent\s+rights\s+are\s+granted\s+by\s+this\s+licen[cs]e", 75),
    ("Apache-2.0", "apache", r"licen[cs]ed\s+under\s+the\s+apache\s+licen[cs]e,\s+version\s+2\.0\s+\(the\s+[\"']?licen[cs]e[\"']?\)", 96),
    ("Apache-2.0", "compliance", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[cs]e", 63),
    ("Apache-2.0", "basis", r"distributed\s+under\s+the\s+licen[cs]e\s+is\s+distributed\s+on\s+an\s+[\"']as\s+is[\"']\s+basis", 63),
    ("Apache-2.0", "contributor", r"grant\s+of\s+patent\s+licen[cs]e\.\s+subject\s+to\s+the\s+terms\s+and\s+conditions\s+of\s+this\s+licen[cs]e,\s+each\s+contributor", 70),
    ("GPL-2.0-or-later", "option", r"either\s+version\s+2\s+of\s+the\s+licen[cs]e,\s+or\s+\(?at\s+your\s+option\)?\s+any\s+later\s+version", 88),
    ("GPL-3.0-or-later", "foundation", r"gnu\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation,\s+either\s+version\s+3\s+of\s+the\s+licen[cs]e", 92),
    ("GPL-2.0-only", "gnu", r"gnu\s+general\s+public\s+licen[cs]e,?\s+version\s+2\s+only", 92),
    ("LGPL-2.1-or-later", "lesser", r"gnu\s+lesser\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation;?,?\s+either\s+version\s+2\.1", 92),
    ("LGPL-3.0-or-later", "lesser", r"gnu\s+lesser\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation;?,?\s+either\s+version\s+3", 92),
    ("AGPL-3.0-or-later", "affero", r"gnu\s+affero\s+general\s+public\s+licen[cs]e\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation,?\s+either\s+version\s+3", 92),
    ("GPL", "hope", r"distributed\s+in\s+the\s+hope\s+that\s+it\s+will\s+be\s+useful,\s+but\s+without\s+any\s+warranty", 40),
    ("GPL", "received", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public\s+licen[cs]e", 41),
    ("AGPL", "received", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+affero\s+general\s+public\s+licen[cs]e", 42),
    ("LGPL", "received", r"you\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+lesser\s+general\s+public\s+licen[cs]e", 42),
    ("GPL", "classpath", r"classpath[\s-]+exception", 43),
    ("GPL-3.0-only", "copyleft", r"the\s+gnu\s+general\s+public\s+licen[cs]e\s+is\s+a\s+free,\s+copyleft\s+licen[cs]e", 71),
    ("MPL-2.0", "mozilla", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+licen[cs]e,\s+v\.\s+2\.0", 94),
    ("MPL-1.1", "mozilla", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+licen[cs]e\s+version\s+1\.1", 94),
    ("EPL-2.0", "accompanying", r"this\s+program\s+and\s+the\s+accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[cs]e\s+2\.0", 94),
    ("EPL-1.0", "accompanying", r"accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+licen[cs]e\s+v1\.0", 94),
    ("CDDL-1.0", "cddl distribution", r"the\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development\s+and\s+distribution\s+licen[cs]e", 88),
    ("BSL-1.0", "boost", r"distributed\s+under\s+the\s+boost\s+software\s+licen[cs]e,\s+version\s+1\.0", 94),
    ("BSL-1.0", "machine-executable", r"machine-executable\s+object\s+code\s+generated\s+by\s+a\s+source\s+language\s+processor", 70),
    ("Zlib", "altered", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such", 70),
    ("Zlib", "misrepresented", r"the\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented", 70),
    ("Unlicense", "anyone", r"anyone\s+is\s+free\s+to\s+copy,\s+modify,\s+publish,\s+use,\s+compile,\s+sell,\s+or\s+distribute\s+this\s+software", 70),
    ("WTFPL", "want", r"you\s+just\s+do\s+what\s+the\s+f\S{2,4}\s+you\s+want\s+to", 70),
    ("Beerware", "beer", r"you\s+can\s+buy\s+me\s+a\s+beer\s+in\s+return", 70),
    ("CC0-1.0", "waive", r"waived\s+all\s+copyright\s+and\s+related\s+or\s+neighbou?ring\s+rights", 70),
    ("CC-BY-4.0", "attribution", r"this\s+work\s+is\s+licen[cs]ed\s+under\s+a\s+creative\s+commons\s+attribution\s+4\.0", 93),
    ("CC-BY-SA-4.0", "sharealike", r"this\s+work\s+is\s+licen[cs]ed\s+under\s+a\s+creative\s+commons\s+attribution-sharealike\s+4\.0", 93),
    ("OFL-1.1", "font", r"this\s+font\s+software\s+is\s+licen[cs]ed\s+under\s+the\s+sil\s+open\s+font\s+licen[cs]e", 93),
    ("Artistic-2.0", "artistic", r"everyone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+copies\s+of\s+this\s+artistic\s+licen[cs]e", 60),
    ("PostgreSQL", "california", r"in\s+no\s+event\s+shall\s+the\s+university\s+of\s+california\s+be\s+liable\s+to\s+any\s+party", 62),
    ("NCSA", "deal", r"to\s+deal\s+with\s+the\s+software\s+without\s+restriction,\s+including\s+without\s+limitation\s+the\s+rights", 66),
    ("MIT", "deal", r"to\s+deal\s+in\s+the\s+software\s+without\s+restriction,\s+including\s+without\s+limitation\s+the\s+rights", 66),
    ("SSPL-1.0", "service", r"make\s+the\s+functionality\s+of\s+the\s+program\s+or\s+a\s+modified\s+version\s+available\s+to\s+third\s+parties\s+as\s+a\s+service", 70),
    ("BUSL-1.1", "anniversary", r"effective\s+on\s+the\s+change\s+date,\s+or\s+the\s+fourth\s+anniversary", 70),
    ("Elastic-2.0", "hosted", r"you\s+may\s+not\s+provide\s+the\s+software\s+to\s+third\s+parties\s+as\s+a\s+hosted\s+or\s+managed\s+service", 70),
    ("MS-PL", "contributor", r"each\s+contributor\s+grants\s+you\s+a\s+non-exclusive,\s+worldwide,\s+royalty-free\s+copyright\s+licen[cs]e\s+to\s+reproduce\s+its\s+contribution", 60),
    ("proprietary", "unauthori", r"unauthori[sz]ed\s+(?:copying|use|reproduction|distribution)\s+of\s+this\s+(?:file|software|document|material)", 16),
    ("proprietary", "consent", r"without\s+(?:the\s+)?(?:prior\s+)?(?:express\s+)?written\s+consent\s+of", 14),
    ("proprietary", "agreement", r"end[\s-]+user\s+licen[cs]e\s+agreement", 18),
    ("proprietary", "secret", r"(?:contains|constitutes?)\s+(?:confidential\s+and\s+)?trade\s+secrets?\s+of", 16),
    ("non-commercial", "commercial", r"(?:for\s+)?non-?\s?commercial\s+(?:use|purposes)\s+only", 17),
    ("research-only", "research", r"for\s+(?:academic\s+(?:and|or)\s+)?research\s+(?:use|purposes)\s+only", 17),
    ("copyright", "©", r"©\s*(?:copyright\s+)?\d{4}(?:\s*[-–,]\s*\d{4})*", 5),
    ("unknown", "licen", r"(?:licen[cs]ed|released|distributed|available)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?[^\s.,;]{1,40}(?:\s[^\s.,;]{1,40}){0,4}\s+licen[cs]e", 3),
)


#: Identifiers that are as well names of a program's version: taken for a license only where one is declared or granted.
VERSIONS = ("Python-2.0", "libpng-2.0", "PHP-3.01")
_END = r"(?![\w+-]|\.\d)"


def spdx(i: str) -> tuple[str, ...]:
    """The SPDX identifiers of a license in small letters, the older ones of the GNU licenses too."""
    i = i.lower()
    if i.endswith("-or-later"):
        return i, i[:-9] + "+"
    return (i, i[:-5]) if i.endswith("-only") else (i,)


#: Between two identifiers of an expression, after the first: words are no identifiers unless the operator is in capitals.
_STRONG = "|".join(f"(?<={x})" for x in (r"-\d\.\d", r"-\d\.\d\+", "-only", "-or-later", "-clause", "-exception", "0bsd", "mit-0"))
_WEAK = "|".join(f"(?<={re.escape(x.lower())})" for x, *_ in NAMES if "-" not in x)
_OPERATOR = r"(?=\)*(?:\s+(?:or|and)\s|\s*/))(?:(?:" + _STRONG + r")\)*(?:\s+(?:or|and)\s+|\s*/\s*)|(?:" + _WEAK + r")\)*\s+(?-i:OR|AND)\s+)"


#: Open repetitions in the expressions above, in the bounds they stand for: lines wrap, nobody indents by more than 20.
_BOUNDS = ((r"\s+", r"\s{1,20}"), (r"\s*", r"\s{0,20}"), (r"[\s-]+", r"[\s-]{1,20}"), (r"[\s-]*", r"[\s-]{0,20}"), (r"[,\s-]+", r"[,\s-]{1,20}"), (r"\S+", r"\S{1,80}"), (r"\)*", r"\){0,4}"), (r"\(*", r"\({0,4}"), (r"[a-z/-]*", r"[a-z/-]{0,60}"), (r"[a-z/]*", r"[a-z/]{0,40}"), (r"[a-z-]+", r"[a-z-]{1,40}"), (r"[0-9./]*", r"[0-9./]{0,20}"), (r"[\w.+-]*", r"[\w.+-]{0,40}"), (r"[+-]+", r"[+-]{1,4}"), (r"[\"'(\[]*", r"[\"'(\[]{0,8}"), (r"\d{4})*", r"\d{4}){0,40}"))
#: What follows an address, of any length.
_TAIL = re.compile(r"[^\s<>\"')\]]*")
#: What a look ahead or behind can see beside a match.
_SIDE = 128


def bounded(pattern: str) -> str:
    for open_, closed in _BOUNDS:
        pattern = pattern.replace(open_, closed)
    return pattern


class Rule(NamedTuple):
    name: str
    license: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    tail: bool = False

    def ends(self, text: str, m: re.Match) -> int:
        return _TAIL.match(text, m.end()).end() if self.tail else m.end()


def rules() -> list[Rule]:
    """All rules in order of precedence."""
    out = []
    for i, words, name, url in NAMES:
        k = tuple(words.split())
        ids = "(?:" + "|".join(map(re.escape, spdx(i))) + ")" + _END
        own = (spdx(i)[-1],)
        out.append(Rule(f"{i}.declared", i, own, r"licen[cs]es?[\"']?\s*(?:=>|[:=])\s*[\"'(\[]*" + ids + r"(?:\s+licen[cs]e)?", 95))
        if "-" in i and i not in VERSIONS or i == "0BSD":
            out.append(Rule(f"{i}.id", i, (i.lower(),), r"(?<![\w.+-])" + re.escape(i.lower()) + _END, 82))
        else:
            out.append(Rule(f"{i}.operand", i, own, _OPERATOR + r"\(*" + ids, 95))
        out.append(Rule(f"{i}.tag", i, ("spdx-license-identifier",), r"spdx-license-identifier:\s*\(*(?:" + "|".join(map(re.escape, spdx(i))) + r")(?![\w.+-]*\w)", 100))
        out.append(Rule(f"{i}.grant", i, k, r"(?:licen[cs]ed|released|distributed|published|provided|available|covered|redistribute(?:d)?|used?)\s+(?:by\s+\S+\s+)?under\s+(?:a\s+|an\s+)?(?:the\s+)?(?:(?:terms|conditions)(?:\s+and\s+conditions)?\s+of\s+)?(?:the\s+)?(?:(?:" + name + r")(?![\w+-])|" + ids + r"(?:\s+licen[cs]e)?|" + name + ")", 90))
        out.append(Rule(f"{i}.name", i, k, r"(?<![a-z0-9])(?:" + name + ")", 80))
        if url:
            out.append(Rule(f"{i}.address", i, (re.match(r"[a-z0-9]+", url.replace("\\", "")).group(),), r"(?:https?://)?(?:www\.)?(?:" + url + r")", 85, True))
    out += [Rule(f"{i}.text{n}", i, tuple(k.split()), p, pr) for n, (i, k, p, pr) in enumerate(SENTENCES)]
    return sorted((r._replace(pattern=bounded(r.pattern)) for r in out), key=lambda r: (-r.priority, r.name))


Hit = tuple[str, str, int, int, int]


def resolve(hits: list[Hit]) -> list[Hit]:
    """Precedence is priority, then length, then the earlier, then the rule's name. What lies within a detection that has precedence, or holds one whole, is suppressed; partial overlaps stay."""
    taken: list[Hit] = []
    starts: list[int] = []
    for h in sorted(set(hits), key=lambda h: (-h[4], h[2] - h[3], h[2], h[1])):
        # None of those taken holds another, so in order of start they are in order of end: only the neighbours count.
        k = bisect_right(starts, h[2])
        if k and h[3] <= taken[k - 1][3]:
            continue
        k = bisect_left(starts, h[2])
        if k < len(taken) and taken[k][3] <= h[3]:
            continue
        starts.insert(k, h[2])
        taken.insert(k, h)
    return taken


@functools.lru_cache(1)
def finder() -> Callable[[str], list[Hit]]:
    all_rules = rules()
    compiled = [re.compile(r.pattern, re.I) for r in all_rules]
    machine = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for n, r in enumerate(all_rules):
        for k in r.keywords:
            by.setdefault(k, []).append(n)
    for k, ns in by.items():
        machine.add_word(k, ns)
    machine.make_automaton()
    reach = [width(r.pattern) + _SIDE for r in all_rules]

    def see(text: str) -> list[Hit]:
        at: dict[int, list[int]] = {}
        for end, ns in machine.iter(lowered(text)):
            for n in ns:
                at.setdefault(n, []).append(end)
        hits: list[Hit] = []
        for n, ends in at.items():
            r, x = all_rules[n], compiled[n]
            for s, e in windows(ends, len(text), reach[n]):
                hits += [(r.license, r.name, m.start(), r.ends(text, m), r.priority) for m in x.finditer(text, s, e)]
        return resolve(hits) if hits else []

    return see


def width(pattern: str) -> int:
    """The most characters that an expression matches."""
    return re._parser.parse(pattern, re.I).getwidth()[1]


def windows(ends: list[int], size: int, reach: int) -> list[tuple[int, int]]:
    """Stretches around the places where keywords end, merged: a match with such a keyword lies, with all that it looks at, in one."""
    out: list[list[int]] = []
    for e in ends:
        s, t = max(0, e - reach), min(size, e + reach)
        if out and s <= out[-1][1]:
            out[-1][1] = t
        else:
            out.append([s, t])
    return [(s, t) for s, t in out]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("found", pa.string())])


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, rule, start, end, priority, found)`` of every license reference that no other suppresses.

    Names are known in words and as SPDX identifiers; of an SPDX expression every identifier is one reference. Each expression
    has a greatest length and is tried that far around its keywords, an address goes on as long as it does; case doesn't matter. Null and empty texts have none; a null
    id is carried on; repeated rows give repeated results; texts of any length are read whole; other columns are ignored, whatever their names; ids are integers.
    """
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = finder()
        for b in it:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                out += [(i, *h, t[h[2] : h[3]]) for h in see(t)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return src.mapInArrow(run, "doc_id long, license string, rule string, start long, end long, priority int, found string")

"""The signature rules of the license scan, written on lower-case words with single spaces.

Each line: priority, label, keyword, pattern. A match of the pattern holds the keyword. Priorities: 5 machine-readable
tags, 4 sentences of licence texts and grants, 3 names with a version, 2 names, 1 hints. Rules are ordered: of two equal
detections the earlier rule is named.
"""

from __future__ import annotations

# The rules.
RULES = r"""
5 apache-2.0      spdx             spdx licen[cs]e identifier apache 2 0
5 apache-1.1      spdx             spdx licen[cs]e identifier apache 1 1
5 mit             spdx             spdx licen[cs]e identifier mit
5 mit-0           spdx             spdx licen[cs]e identifier mit 0
5 isc             spdx             spdx licen[cs]e identifier isc
5 zlib            spdx             spdx licen[cs]e identifier zlib
5 bsd-2-clause    spdx             spdx licen[cs]e identifier bsd 2 clause
5 bsd-3-clause    spdx             spdx licen[cs]e identifier bsd 3 clause
5 bsd-4-clause    spdx             spdx licen[cs]e identifier bsd 4 clause
5 0bsd            spdx             spdx licen[cs]e identifier 0bsd
5 gpl-1.0         spdx             spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
5 gpl-2.0         spdx             spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
5 gpl-3.0         spdx             spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
5 lgpl-2.0        spdx             spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
5 lgpl-2.1        spdx             spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
5 lgpl-3.0        spdx             spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
5 agpl-3.0        spdx             spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
5 gfdl-1.3        spdx             spdx licen[cs]e identifier gfdl 1 3(?: only| or later)?
5 mpl-1.1         spdx             spdx licen[cs]e identifier mpl 1 1
5 mpl-2.0         spdx             spdx licen[cs]e identifier mpl 2 0(?: no copyleft exception)?
5 epl-1.0         spdx             spdx licen[cs]e identifier epl 1 0
5 epl-2.0         spdx             spdx licen[cs]e identifier epl 2 0
5 cddl-1.0        spdx             spdx licen[cs]e identifier cddl 1 0
5 cddl-1.1        spdx             spdx licen[cs]e identifier cddl 1 1
5 eupl-1.2        spdx             spdx licen[cs]e identifier eupl 1 2
5 bsl-1.0         spdx             spdx licen[cs]e identifier bsl 1 0
5 busl-1.1        spdx             spdx licen[cs]e identifier busl 1 1
5 sspl-1.0        spdx             spdx licen[cs]e identifier sspl 1 0
5 unlicense       spdx             spdx licen[cs]e identifier unlicense
5 wtfpl           spdx             spdx licen[cs]e identifier wtfpl
5 artistic-2.0    spdx             spdx licen[cs]e identifier artistic 2 0
5 ofl-1.1         spdx             spdx licen[cs]e identifier ofl 1 1
5 odbl-1.0        spdx             spdx licen[cs]e identifier odbl 1 0
5 cc0-1.0         spdx             spdx licen[cs]e identifier cc0 1 0
5 cc-by-3.0       spdx             spdx licen[cs]e identifier cc by 3 0
5 cc-by-4.0       spdx             spdx licen[cs]e identifier cc by 4 0
5 cc-by-sa-3.0    spdx             spdx licen[cs]e identifier cc by sa 3 0
5 cc-by-sa-4.0    spdx             spdx licen[cs]e identifier cc by sa 4 0
5 cc-by-nc-4.0    spdx             spdx licen[cs]e identifier cc by nc 4 0
5 cc-by-nd-4.0    spdx             spdx licen[cs]e identifier cc by nd 4 0
5 cc-by-nc-sa-4.0 spdx             spdx licen[cs]e identifier cc by nc sa 4 0
5 cc-by-nc-nd-4.0 spdx             spdx licen[cs]e identifier cc by nc nd 4 0
4 apache-2.0      apache           licen[cs]ed under the apache licen[cs]e version 2 0(?: the licen[cs]e)?
4 apache-2.0      apache           (?:released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version)? 2 0
4 apache-2.0      apache           www apache org licen[cs]es licen[cs]e 2 0
4 apache          apache           (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e
4 apache-2.0      each contributor subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you
4 mit             hereby granted   permission is hereby granted free of charge to any person obtaining a copy of this software
4 mit             mit              (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
4 mit             opensource       opensource org licen[cs]es mit
4 mit             copies or        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
4 isc             hereby granted   permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
4 isc             isc              (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
4 bsd             redistribution   redistribution and use in source and binary forms with or without modification are permitted
4 bsd-3-clause    endorse          may be used to endorse or promote products derived from this software without specific prior written permission
4 bsd-4-clause    advertising      all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
4 bsd             bsd              (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?(?:new |modified |simplified |revised )?bsd(?: style)?(?: licen[cs]e)?
4 bsd-2-clause    bsd              (?:licen[cs]ed|released|distributed) under (?:the )?(?:simplified|2 clause|two clause) bsd licen[cs]e
4 bsd-3-clause    bsd              (?:licen[cs]ed|released|distributed) under (?:the )?(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e
4 zlib            misrepresented   the origin of this software must not be misrepresented
4 zlib            zlib             (?:licen[cs]ed|released|distributed) under (?:the )?zlib(?: libpng)? licen[cs]e
4 gpl             general public   (?:it|and or modify it) under the terms of the gnu general public licen[cs]e
4 gpl-2.0         general public   gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2(?: of the licen[cs]e)?
4 gpl-3.0         general public   gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3(?: of the licen[cs]e)?
4 gpl             general public   (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[cs]e
4 gpl             gpl              (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
4 gpl             general public   you should have received a copy of the gnu general public licen[cs]e
4 gpl             gnu org          www gnu org licen[cs]es gpl(?: \d \d)?(?: html| txt)?
4 lgpl            general public   under the terms of the gnu (?:lesser|library) general public licen[cs]e
4 lgpl-2.1        general public   gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 2 1
4 lgpl-3.0        general public   gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 3
4 lgpl            general public   you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
4 lgpl            lgpl             (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
4 agpl            affero           under the terms of the gnu affero general public licen[cs]e
4 agpl-3.0        affero           gnu affero general public licen[cs]e as published by the free software foundation (?:either )?version 3
4 agpl            affero           you should have received a copy of the gnu affero general public licen[cs]e
4 agpl            agpl             (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
4 gfdl            documentation    permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
4 mpl-2.0         mozilla          this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
4 mpl-1.1         mozilla          the contents of this file are subject to the mozilla public licen[cs]e version 1 1
4 mpl             mozilla          subject to the terms of the mozilla public licen[cs]e
4 mpl             mozilla          (?:licen[cs]ed|released|distributed) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e
4 mpl-2.0         mozilla          mozilla org mpl 2 0
4 epl             eclipse          (?:made available|licen[cs]ed|released) under (?:the )?terms of the eclipse public licen[cs]e(?: v(?:ersion)?)?
4 epl-1.0         eclipse          www eclipse org legal epl v10(?: html)?
4 epl-2.0         eclipse          www eclipse org legal epl (?:2 0|v20)(?: html)?
4 cddl            common dev       subject to the terms of the common development and distribution licen[cs]e
4 eupl            eupl             licen[cs]ed under the eupl
4 bsl-1.0         boost            distributed under the boost software licen[cs]e version 1 0
4 bsl-1.0         boost            www boost org licen[cs]e 1 0 txt
4 unlicense       unencumbered     this is free and unencumbered software released into the public domain
4 unlicense       unlicense        unlicense org
4 wtfpl           do what the      do what the fuck you want to(?: public licen[cs]e)?
4 artistic        artistic         under the same terms as perl(?: itself)?(?: and the)? artistic licen[cs]e
4 perl            perl             (?:under|on) the same terms as perl(?: \d)?(?: itself)?
4 psf             python           python software foundation licen[cs]e(?: agreement)? version 2
4 ruby            ruby             (?:under|on) the same terms as ruby(?: itself)?
4 php             php              this source file is subject to version \d \d+ of the php licen[cs]e
4 openssl         openssl          this product includes software developed by the openssl project
4 w3c             w3c              w3c software (?:notice and licen[cs]e|and document notice)
4 ofl             sil open         this font software is licen[cs]ed under the sil open font licen[cs]e
4 odbl            open database    made available under the open database licen[cs]e
4 cc-by           commons          (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution(?: \d \d)?(?: international| unported| generic)? licen[cs]e
4 cc-by-sa        commons          (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution share ?alike(?: \d \d)?(?: international| unported| generic)? licen[cs]e
4 cc-by-nc        commons          (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution non ?commercial(?: \d \d)?(?: international| unported| generic)? licen[cs]e
4 cc-by-nd        commons          (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution no ?deriv(?:ative)?s?(?: \d \d)?(?: international| unported| generic)? licen[cs]e
4 cc-by-nc-sa     commons          (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported| generic)? licen[cs]e
4 cc-by-nc-nd     commons          (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: \d \d)?(?: international| unported| generic)? licen[cs]e
4 cc-by           cc by            (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?cc by(?: \d \d)?(?: licen[cs]e)?
4 cc-by-sa        cc by sa         (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?cc by sa(?: \d \d)?(?: licen[cs]e)?
4 cc-by-nc        cc by nc         (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?cc by nc(?: \d \d)?(?: licen[cs]e)?
4 cc-by-nd        cc by nd         (?:licen[cs]ed|released|available|distributed|published) under (?:a |the )?(?:terms of )?(?:the )?cc by nd(?: \d \d)?(?: licen[cs]e)?
4 cc-by           creativecommons  creativecommons org licen[cs]es by \d \d
4 cc-by-sa        creativecommons  creativecommons org licen[cs]es by sa \d \d
4 cc-by-nc        creativecommons  creativecommons org licen[cs]es by nc \d \d
4 cc-by-nd        creativecommons  creativecommons org licen[cs]es by nd \d \d
4 cc-by-nc-sa     creativecommons  creativecommons org licen[cs]es by nc sa \d \d
4 cc-by-nc-nd     creativecommons  creativecommons org licen[cs]es by nc nd \d \d
4 cc0             creativecommons  creativecommons org publicdomain zero 1 0
4 public-domain   creativecommons  creativecommons org publicdomain mark 1 0
4 public-domain   public domain    (?:has been |is |are |was )?(?:placed|dedicated|released) (?:in|into|to) the public domain
4 public-domain   public domain    waive(?:s|d)? all copyright and related or neighboring rights(?: \w+){0,12} public domain
4 proprietary     proprietary      proprietary and confidential
4 proprietary     unauthori        unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or (?:copying|reproduction|use|distribution))* (?:of this (?:file|work|document|software|material) )?is (?:strictly )?prohibited
4 proprietary     reproduced       no part of this (?:publication|book|work|document|website) may be reproduced
4 proprietary     written          without (?:the )?(?:express |prior )*written (?:permission|consent) of the (?:publisher|author|owner|copyright holder|copyright owner)
4 reserved        reserved         copyright (?:c )?(?:\d{4} )+(?:\w+ ){0,8}all rights reserved
3 apache-2.0      apache           apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?
3 apache-1.1      apache           apache(?: software)? licen[cs]e(?: version| v)? 1 1
3 apache-1.0      apache           apache(?: software)? licen[cs]e(?: version| v)? 1 0
3 apache-2.0      apache           apache 2 0
3 gpl-1.0         general public   (?:gnu )?general public licen[cs]e(?: version| v)? 1(?: 0)?(?: or (?:any )?later)?
3 gpl-2.0         general public   (?:gnu )?general public licen[cs]e(?: version| v)? 2(?: 0)?(?: or (?:any )?later)?
3 gpl-3.0         general public   (?:gnu )?general public licen[cs]e(?: version| v)? 3(?: 0)?(?: or (?:any )?later)?
3 gpl-2.0         gpl              (?:gnu )?gpl(?: version| v)? 2(?: 0)?(?: only| or later)?
3 gpl-3.0         gpl              (?:gnu )?gpl(?: version| v)? 3(?: 0)?(?: only| or later)?
3 gpl-2.0         gplv2            gplv2(?: only| or later)?
3 gpl-3.0         gplv3            gplv3(?: only| or later)?
3 lgpl-2.0        general public   (?:gnu )?library general public licen[cs]e(?: version| v)? 2(?: 0)?
3 lgpl-2.1        general public   (?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1(?: or (?:any )?later)?
3 lgpl-3.0        general public   (?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)?(?: or (?:any )?later)?
3 lgpl-2.1        lgpl             (?:gnu )?lgpl(?: version| v)? 2 1(?: only| or later)?
3 lgpl-3.0        lgpl             (?:gnu )?lgpl(?: version| v)? 3(?: 0)?(?: only| or later)?
3 lgpl-2.1        lgplv2           lgplv2(?: 1)?
3 lgpl-3.0        lgplv3           lgplv3
3 agpl-3.0        affero           (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?(?: or (?:any )?later)?
3 agpl-3.0        agpl             agpl(?: version| v)? 3(?: 0)?
3 agpl-3.0        agplv3           agplv3
3 gfdl-1.3        documentation    (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 3
3 gfdl-1.2        documentation    (?:gnu )?free documentation licen[cs]e(?: version| v)? 1 2
3 mpl-2.0         mozilla          mozilla public licen[cs]e(?: version| v)? 2 0
3 mpl-1.1         mozilla          mozilla public licen[cs]e(?: version| v)? 1 1
3 mpl-2.0         mpl              mpl 2 0
3 mpl-1.1         mpl              mpl 1 1
3 epl-2.0         eclipse          eclipse public licen[cs]e(?: version| v)? 2 0
3 epl-1.0         eclipse          eclipse public licen[cs]e(?: version| v)? 1 0
3 cddl-1.0        common dev       common development and distribution licen[cs]e(?: version| v)? 1 0
3 cddl-1.0        cddl             cddl 1 0
3 eupl-1.1        eupl             eupl(?: version| v)? 1 1
3 eupl-1.2        eupl             eupl(?: version| v)? 1 2
3 bsd-2-clause    bsd              (?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?
3 bsd-3-clause    bsd              (?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?
3 bsd-2-clause    bsd              bsd 2 clause(?: licen[cs]e)?
3 bsd-3-clause    bsd              bsd 3 clause(?: licen[cs]e)?
3 bsd-4-clause    bsd              bsd 4 clause(?: licen[cs]e)?
3 bsd-4-clause    bsd              original bsd licen[cs]e
3 bsl-1.0         boost            boost software licen[cs]e(?: version| v)? 1 0
3 busl-1.1        business         business source licen[cs]e(?: version| v)? 1 1
3 sspl-1.0        server side      server side public licen[cs]e(?: version| v)? 1
3 artistic-1.0    artistic         artistic licen[cs]e(?: version| v)? 1 0
3 artistic-2.0    artistic         artistic licen[cs]e(?: version| v)? 2 0
3 osl-3.0         open software    open software licen[cs]e(?: version| v)? 3 0
3 afl-3.0         academic         academic free licen[cs]e(?: version| v)? 3 0
3 zpl-2.1         zope             zope public licen[cs]e(?: version| v)? 2 1
3 cecill-2.1      cecill           cecill(?: free software licen[cs]e)?(?: version| v)? 2 1
3 lppl-1.3        latex            latex project public licen[cs]e(?: version| v)? 1 3
3 ofl-1.1         open font        (?:sil )?open font licen[cs]e(?: version| v)? 1 1
3 cc-by-1.0       cc by            cc by 1 0
3 cc-by-2.0       cc by            cc by 2 0
3 cc-by-2.5       cc by            cc by 2 5
3 cc-by-3.0       cc by            cc by 3 0
3 cc-by-4.0       cc by            cc by 4 0
3 cc-by-sa-2.0    cc by sa         cc by sa 2 0
3 cc-by-sa-2.5    cc by sa         cc by sa 2 5
3 cc-by-sa-3.0    cc by sa         cc by sa 3 0
3 cc-by-sa-4.0    cc by sa         cc by sa 4 0
3 cc-by-nc-3.0    cc by nc         cc by nc 3 0
3 cc-by-nc-4.0    cc by nc         cc by nc 4 0
3 cc-by-nd-4.0    cc by nd         cc by nd 4 0
3 cc-by-nc-sa-3.0 cc by nc sa      cc by nc sa 3 0
3 cc-by-nc-sa-4.0 cc by nc sa      cc by nc sa 4 0
3 cc-by-nc-nd-4.0 cc by nc nd      cc by nc nd 4 0
3 cc-by-3.0       commons          creative commons attribution 3 0(?: international| unported)?
3 cc-by-4.0       commons          creative commons attribution 4 0(?: international)?
3 cc-by-sa-3.0    commons          creative commons attribution share ?alike 3 0(?: international| unported)?
3 cc-by-sa-4.0    commons          creative commons attribution share ?alike 4 0(?: international)?
3 cc0-1.0         cc0              cc0 1 0(?: universal)?
2 apache          apache           apache(?: software)?(?: public)? licen[cs]es?
2 gpl             general public   (?:gnu )?general public licen[cs]es?
2 gpl             gpl              gnu gpl
2 lgpl            general public   (?:gnu )?(?:lesser|library) general public licen[cs]es?
2 lgpl            lgpl             (?:gnu )?lgpl
2 agpl            affero           (?:gnu )?affero general public licen[cs]es?
2 agpl            agpl             (?:gnu )?agpl
2 gfdl            documentation    (?:gnu )?free documentation licen[cs]es?
2 mpl             mozilla          mozilla public licen[cs]es?
2 epl             eclipse          eclipse public licen[cs]es?
2 cddl            common dev       common development and distribution licen[cs]es?
2 cddl            cddl             cddl
2 cpl             common public    common public licen[cs]es?
2 ipl             ibm              ibm public licen[cs]es?
2 eupl            european         european union public licen[cs]es?
2 bsd             bsd              bsd(?: style)? licen[cs]es?
2 mit             mit              mit licen[cs]es?
2 mit             expat            expat licen[cs]es?
2 isc             isc              isc licen[cs]es?
2 zlib            zlib             zlib(?: libpng)? licen[cs]es?
2 unlicense       unlicense        the unlicense
2 wtfpl           wtfpl            wtfpl
2 boost           boost            boost software licen[cs]es?
2 business        business         business source licen[cs]es?
2 sspl            server side      server side public licen[cs]es?
2 elastic         elastic          elastic licen[cs]e(?: 2 0)?
2 commons-clause  commons clause   commons clause(?: licen[cs]e condition)?
2 artistic        artistic         artistic licen[cs]es?
2 osl             open software    open software licen[cs]es?
2 afl             academic         academic free licen[cs]es?
2 psf             python           python software foundation licen[cs]es?
2 zpl             zope             zope public licen[cs]es?
2 ofl             open font        (?:sil )?open font licen[cs]es?
2 lppl            latex            latex project public licen[cs]es?
2 cecill          cecill           cecill(?: b| c)?(?: licen[cs]es?)?
2 openssl         openssl          openssl licen[cs]es?
2 postgresql      postgresql       postgresql licen[cs]es?
2 php             php              php licen[cs]es?
2 ruby            ruby             ruby licen[cs]es?
2 ms-pl           microsoft        microsoft public licen[cs]es?
2 ms-rl           microsoft        microsoft reciprocal licen[cs]es?
2 odbl            open database    open database licen[cs]es?
2 odc-by          open data        open data commons attribution licen[cs]es?
2 pddl            open data        open data commons public domain dedication(?: and licen[cs]e)?
2 ogl             open government  open government licen[cs]es?(?: v\d(?: \d)?)?
2 cc0             cc0              cc0
2 cc-by           cc by            cc by
2 cc-by-sa        cc by sa         cc by sa
2 cc-by-nd        cc by nd         cc by nd
2 cc-by-nc        cc by nc         cc by nc
2 cc-by-nc-sa     cc by nc sa      cc by nc sa
2 cc-by-nc-nd     cc by nc nd      cc by nc nd
2 cc-by           commons          creative commons attribution(?: licen[cs]es?)?
2 cc-by-sa        commons          creative commons attribution share ?alike(?: licen[cs]es?)?
2 cc-by-nc        commons          creative commons attribution non ?commercial(?: licen[cs]es?)?
2 cc-by-nd        commons          creative commons attribution no ?deriv(?:ative)?s?(?: licen[cs]es?)?
2 public-domain   public domain    (?:in|into|to) the public domain
2 reserved        reserved         all rights reserved
2 reserved        reserved         some rights reserved
1 gpl             gpl              gpl
1 bsd             bsd              bsd(?: style)?
1 mpl             mpl              mpl
1 eupl            eupl             eupl
1 creative-commons commons         creative commons(?: licen[cs]es?)?
1 public-domain   public domain    public domain
1 proprietary     proprietary      proprietary (?:software|licen[cs]e|information|material)
1 permissive      permissive       permissive(?:ly)? licen[cs]ed?
1 copyleft        copyleft         copyleft
"""

# Words of which each rule's keyword or pattern holds one, so that a text without any of them has no match.
GATES = [
    "licen", "spdx", "reserved", "gpl", "public domain", "publicdomain", "cc by", " cc0 ", "creative commons", "commons clause", "copyleft", "proprietary",
    " mpl ", "mozilla org mpl", " cddl ", " eupl ", " bsd ", "cecill", "wtfpl", "apache 2 0", "eclipse org legal", "hereby granted", "permission notice shall",
    "redistribution and use in", "used to endorse or promote", "all advertising materials", "must not be misrepresented", "unencumbered software",
    "do what the fuck", "same terms as perl", "same terms as ruby", "by the openssl project", "w3c software", "unauthori", "no part of this", "written permission", "written consent",
]


def rules() -> list[tuple[int, str, str, int, str]]:
    """(number, keyword, pattern, priority, label), in order."""
    out = []
    for i, row in enumerate(RULES.strip().splitlines()):
        priority, label = row.split()[:2]
        out.append((i, row[18:35].strip(), row[35:], int(priority), label))
    return out

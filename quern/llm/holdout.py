"""Texts written and labelled by hand: SEEDS train, so that a class the sample lacks is known; HOLDOUT calibrates and never trains."""

HOLDOUT = (
    ("prose", "The old bridge was closed for repairs in May, and nobody in the village knew when it would open again."),
    ("prose", "We walked along the river until the rain began. Then we waited under a tree for almost an hour."),
    ("prose", "Dear Anna,\n\nthank you for the letter. I will be in town next week and would like to see you.\n\nBest wishes\nPaul"),
    ("prose", "she said that the meeting was moved to friday but nobody told us and so we sat there for an hour and waited for the others to come"),
    ("prose", "Die Nachbarn haben den Garten im Herbst verkauft, obwohl sie lange gezögert hatten. Seitdem ist es still geworden."),
    ("prose", "El tren salió con retraso porque había nieve en las vías. Los viajeros esperaron en la estación hasta la noche."),
    ("prose", "Po dlouhé zimě se lidé konečně vrátili do parku. Děti si hrály u rybníka a nikdo nikam nespěchal."),
    ("prose", "<p>The report was published on Monday.</p>\n<p>It says that most of the money was spent on roads, and that the rest is still there.</p>"),
    ("prose", "“Where have you been?” asked Tom.\n“I was at the station,” she said, “but the train did not come.”"),
    ("prose", "For the cake you need:\n- two eggs\n- some flour\nMix the eggs with the flour, add a little milk, and let the dough rest for an hour. Then bake it until it is brown."),
    ("prose", "# A short trip\n\nIn the morning we took the bus to the coast. The weather was better than we\nhad hoped, and in the afternoon we even went for a swim."),
    ("prose", "V sobotu jsme jeli na výlet, ale cesta byla dlouhá a unavená. Večer jsme byli rádi, že jsme doma."),
    ("list", "- green apples\n- brown bread\n- two lemons\n- cold butter\n- rice\n- olive oil"),
    ("list", "1. wooden chair\n2. small lamp\n3. round table\n4. blue carpet\n5. mirror"),
    ("list", "hammer, nails, wood glue, paint brush, ladder, screws, tape measure, pliers, sand paper"),
    ("list", "Silver Ring\nOld Map\nGlass Bottle\nLeather Bag\nIron Key\nWool Blanket"),
    ("list", "Things to pack:\n[ ] passport\n[ ] rain coat\n[ ] camera (small)\n[ ] phone charger\n[ ] books"),
    ("list", "red bike / old tent / garden hose / folding chair / camp stove / water bottle / sleeping bag"),
    ("list", "a) Prague\nb) Vienna\nc) Madrid\nd) Lisbon\ne) Warsaw\nf) Rome"),
    ("list", "* 3 large pots (steel)\n* 12 spoons\n* 4 bowls\n* tea towels\n* cutting board"),
    ("list", "Tische; Stühle; Lampen; Teppiche; Schränke; Regale; Spiegel; Betten; Kissen; Decken"),
    ("list", "+ violín\n+ dos guitarras\n+ piano viejo\n+ tambor\n+ flauta dulce\n+ trompeta"),
    ("list", "- The bridge was closed in May, and nobody knew why.\n- Two of the boats were sold to a man from the coast.\n- She said that the rest would follow in spring.\n- Nothing was heard of it after that."),
    ("list", "1. Close the valve before you open the lid.\n2. Wait until the light has gone out.\n3. Take the filter out and wash it under cold water.\n4. Put everything back in the same order."),
    ("table", "name,age,city\nAnna,31,Prague\nPaul,28,Vienna\nMaria,45,Madrid\nJan,19,Brno"),
    ("table", "| item | price | stock |\n|---|---|---|\n| chair | 20.5 | 4 |\n| table | 99.0 | 1 |\n| lamp | 12.0 |  |"),
    ("table", "year\tsales\tcosts\n2001\t514\t320\n2002\t602\t411\n2003\t\t389\n2004\t734\t402"),
    ("table", "<tr><td>Monday</td><td>12</td><td>rain</td></tr>\n<tr><td>Tuesday</td><td>15</td><td>sun</td></tr>\n<tr><td>Friday</td><td>9</td><td>fog</td></tr>"),
    ("table", "team      played    won    lost\nnorth     12        7      5\nsouth     12        9      3\nwest      11        2      9"),
    ("table", "code;name;weight\nA1;iron;7.87\nB2;gold;19.3\nC3;lead;11.3\nD4;zinc;7.14"),
    ("table", "  town │ height │ people\n   Ulm │    478 │ 126000\n  Graz │    353 │ 291000\n  Brno │    237 │ 382000"),
    ("table", "Room\tFloor\tSeats\nA\t1\t30\nB\t1\t\nC\t2\t45\nD\t3\t12"),
    ("junk", "#@!! %% <>;: ~~|| ^^ {}[] ++==-- @@## $$ %^&* ()_+ ;;:: //\\\\ ??!! ~~~ <<>>"),
    ("junk", "qwrt zxcvb plkj mnbv ghjkl trwq sdfg hjkl zxcv bnmp qwrtp lkjhg fdsz xcvb nmlk"),
    ("junk", "YWxsIG9mIHRoaXMgaXMganVuaw0KZm9yIHRlc3RzK2FuZC9ub3RoaW5nZWxzZTEyMzQ1Njc4OTBhYmNkZWZnaGlq"),
    ("junk", "3f a91c 07be 55d2 ee10 9a 4c7d 00ff 12ab 8e61 c0de 77 1f3e 5b5b a0a0 9c 3d44 e2"),
    ("junk", "BUY NOW!!! SHOES CHEAP!!! BUY SHOES >>> SHOES NOW!!! $$$ CHEAP SHOES BUY >>> NOW NOW!!! SHOES $$$ BUY"),
    ("junk", "Ã©Ã¨ â‚¬â„¢ Â¿Â¡ ï¿½ï¿½ Ã¶Ã¼ÃŸ â€œâ€� Ã±Ã³ Â»Â« ï¿½ Ã¥Ã¦Ã¸ â€¦ Â©Â® Ã¡Ã­"),
    ("junk", "river stone window paper green seven table cloud letter apple engine yellow corner music house bottle winter pocket silver market garden pencil"),
    ("junk", "click click click here click here here click more click here more more click click here click more here click"),
    ("junk", "Welcome to our page. kj3 99x zz1 p0q 7hh 2k9 xx8 m4m 0o0 t6r 8yy 5gf w2w 3e3 r9r 1a1 b7b"),
    ("junk", "lamp harbor quick violet sand orange kettle forest mirror dozen basket thunder copper ladder velvet saddle marble cotton"),
)

SEEDS = (
    ("prose", "My grandmother kept the letters in a wooden box under the stairs. After the funeral we read them aloud, one after the other, until it was light."),
    ("prose", "the bus was late again so I walked and when I got there they had already started without me which was fine because I was tired anyway"),
    ("prose", "Der Zug hielt mitten auf der Strecke, und niemand wusste warum. Nach einer Stunde fuhr er weiter, als ob nichts gewesen wäre."),
    ("prose", "La tienda cerró el año pasado y desde entonces la plaza está vacía. Nadie ha querido alquilar el local, aunque el precio ha bajado."),
    ("prose", "Starý mlýn stojí u řeky už dvě stě let. Když přijde velká voda, lidé z vesnice se tam chodí dívat."),
    ("list", "- two shirts\n- wool socks\n- torch and batteries\n- rope\n- map of the valley\n- dried fruit"),
    ("list", "1) oak\n2) birch\n3) old maple\n4) silver fir\n5) ash tree\n6) wild cherry\n7) pine"),
    ("list", "pencil, ruler, blue ink, paper clips, stapler, eraser, tape, scissors, folder, glue stick"),
    ("list", "Brown Bread\nGoat Cheese\nApple Juice\nRye Flour\nSea Salt\nGreen Tea\nRed Onion"),
    ("list", "Teller; Gabeln; kleine Löffel; Tassen; Schüsseln; Gläser; Servietten; Tischtuch; Kerzen"),
    ("table", "name;height;weight\nOskar;182;80\nEva;169;61\nJonas;177;\nMarta;171;66\nPetr;190;92"),
    ("table", "| day | high | low |\n|---|---|---|\n| Mon | 21.5 | 12.0 |\n| Tue | 19.0 | 11.5 |\n| Wed |  | 9.0 |"),
    ("table", "player\tgames\tgoals\nNovak\t12\t3\nBraun\t14\t7\nRuiz\t9\t\nHill\t11\t2\nKral\t13\t5"),
    ("table", "model     year      doors     price\nfox       1998      4         3100\nlynx      2004      2         5250\nowl       2011      4         7900"),
    ("table", "port,ships,tons\nNorth,14,88200\nEast,9,40110\nWest,21,120450\nSouth,3,9050"),
    ("junk", "~~##@@ !!;;%% {}{}[] <<>>|| ^^&&** ++--== //\\\\ ::,, ((%%)) @#@# ~!~! ;;## $$%% }{ ]["),
    ("junk", "xkqv brtzz mpplk wqrtn dfghjk zzxcv nnbvt plkrs qqwrt tgbnm ccvbn rfvtg yhnbj mkplq"),
    ("junk", "aGVsbG8gd29ybGQgdGhpcyBpcyBub3RoaW5nIGJ1dCBhIGxvbmcgbGluZSBvZiBjb2RlMDEyMzQ1Njc4OQ=="),
    ("junk", "win win prize prize click win click prize win now now click prize win click now prize win click win prize now"),
    ("junk", "copper lantern meadow seventeen gravel violin curtain almond thunder ribbon harvest pillow cinder maple anchor button"),
)

"""The rule table of the extractors (rows 066, 073, 117 to 157): patterns and limits are fixed values of the format."""

from __future__ import annotations

from tristage.operators.extract import Rule

#: A letter, digit or underscore, in lower case and in both cases.
W = "[0-9a-zа-яё_]"
WW = "[0-9A-Za-zА-Яа-яЁё_]"


def _number(group: str) -> str:
    return f"try_cast(replace(x.{group}, ',', '.') AS double)"


def _between(value: str, low: float, high: float) -> str:
    return f"CASE WHEN {value} BETWEEN {low} AND {high} THEN {value} END"


#: Repeats of groups have bounds: Java matches them by recursion, and a text of any length must not overflow its stack.
#: Fixed values, all tables and patterns from here on: wording and limits that results depend on.
_SYSTEM = r"(?:ВД|ДВ|ДУ|ПД|ДП|КДВ)[0-9]{1,2}(?:\.[0-9]{1,2})?(?:\([0-9]\))?"
_ROOM = r"-?[0-9]{1,2}(?:\.[0-9]{1,2})?-[0-9]{1,3}[а-я]?|[0-9]{1,4}[а-я]?"
_WC = rf"(?:Универсальн|Доступн){WW}+\s+кабин{WW}*(?:\s+(?:уборной|МГН|для\s+(?:МГН|инвалидов)))?|(?:Санузел|Уборная|С/у)\s+(?:для\s+)?(?:МГН|инвалидов)"
_OUTSIDE = r"баланс|кольцев|магистральн|квартал|застройк|q\s?пож|строительств|стройплощадк|точке\s+подключени|технически[а-яё]+\s+услови|потребност"
_LIGHT = {
    "светодиодные": rf"(?<![а-яё])светодиод{W}*",
    "люминесцентные": rf"(?<![а-яё])люминесцентн{W}*(?:\s+и\s+{W}+)?\s+(?:ламп|источник){W}*",
    "накаливания": rf"ламп{W}*\s+накаливани{W}*",
    "галогенные": rf"(?<![а-яё])(?:металло)?галогенн{W}+\s+ламп{W}*",
}
#: Read in upper case, as printed.
_LAMPS = {"ДРЛ": "(?<![А-ЯЁа-яё])ДРЛ(?![А-ЯЁа-яё])", "ДНаТ": "(?<![А-ЯЁа-яё])ДНаТ(?![А-ЯЁа-яё])"}
_NOT_DESIGN = rf"(?:замен{W}*|внедрени{W}*|(?<![а-яё])от\s+|не\s+должно\s+быть|могут\s+быть|рекоменд{W}*|допускается|(?<![а-яё])уч[её]т{W}*|ручн{W}+|переносн{W}+|освещенност{W}*\s+для|коммутационн{W}*|коммутируем{W}*)[^.;]*$"
_WASTE = rf"^[^.;]{{0,20}}?(?:утративш{W}+|отход{W}*)"
_OR_LED = r"|^[^.;]{0,60}?(?<![а-яё])или(?![а-яё])[^.;]{0,40}?(?:led|светодиод)"
_METERS = {
    "электроэнергия": rf"сч[её]тчик{W}*\s+(?:активн{W}+\s+)?(?:(?:электрическ{W}+\s+)?энерги|электроэнерги){W}*|электросч[её]тчик{W}*|энергомера|меркурий[\s-]?[0-9]{{3}}|уч[её]т{W}*\s+(?:активной\s+)?электр{W}*\s*энерги{W}*",
    "вода": rf"водомерн{W}+\s+узл?{W}*|водосч[её]тчик{W}*|сч[её]тчик{W}*\s+(?:крыльчат{W}+\s+)?(?:холодной\s+|горячей\s+)?воды|расходомер[\s-]сч[её]тчик{W}*|сч[её]тчик{W}*\s+крыльчат{W}*",
    "тепловая энергия": rf"теплосч[её]тчик{W}*|узл?{W}*\s+уч[её]та\s+тепловой\s+энергии",
}
_METHODS = {
    "механизированный": rf"механизированн{W}*[^.;]{{0,30}}?(?:метод|способ|снос|демонтаж|разборк)|(?:метод|способ){W}*[^.;]{{0,20}}?механизированн|навесн{W}+\s+(?:разрушающ{W}+\s+)?оборудовани|гидромолот|гидроножниц",
    "ручной": rf"ручн{W}+\s+(?:{W}+\s+)?(?:метод|способ|разборк|демонтаж)|(?:и|,)\s+ручн{W}+\s+метод",
    "поэлементный": rf"поэлементн{W}+\s+(?:разборк|демонтаж|снос)",
    "обрушение": r"(?:методом|способом)\s+обрушени",
    "взрывной": rf"взрывн{W}+\s+(?:метод|способ)|методом\s+взрыв",
}
_TECHNOLOGIES = [
    ("крепление котлована", "шпунт", rf"шпунт{W}*"),
    ("крепление котлована", "стена в грунте", rf"стен{W}*\s+в\s+грунте"),
    ("крепление котлована", "буросекущие сваи", rf"буросекущ{W}+\s+сва"),
    ("крепление котлована", "распорная система", rf"распорн{W}+\s+систем"),
    ("порядок возведения", "сверху вниз (top-down)", rf"top[-\s]?down|полузакрыт{W}+\s+способ"),
    ("каркас", "монолитный железобетон", rf"монолитн{W}+\s+(?:железобетон|ж/?б)"),
    ("каркас", "сборный железобетон", rf"сборн{W}+\s+(?:железобетон|ж/?б)"),
]
_HYDRANTS = "CASE substr(x.n, 1, 4) WHEN 'двух' THEN 2 WHEN 'трех' THEN 3 WHEN 'трёх' THEN 3 WHEN 'четы' THEN 4 WHEN 'пяти' THEN 5 ELSE try_cast(x.n AS int) END"
_FLOW = _number("v")
_JETS = f"CASE WHEN try_cast(x.n AS int) > 0 AND {_FLOW} > 0 THEN concat(try_cast(x.n AS int), 'x', round({_FLOW}, 2)) END"
_KPA = f"round(CASE WHEN substr(x.u, 1, 1) = 'т' THEN {_FLOW} * 10 ELSE {_FLOW} END, 1)"
_LATIN = "upper(translate(x.m, 'АВСЕНКМОРТХасеорх -‑', 'ABCEHKMOPTXaceopx'))"

#: Kinds with their rules.
RULES: dict[str, list[Rule]] = {
    "soue_type": [Rule("soue_type", rf"соуэ\s*(?:\([^)]{{0,40}}\)\s*)?(?:[-–—:]\s*)?(?:не\s+(?:ниже|менее)\s+)?([1-5])\s*-?\s*(?:го\s+)?тип{W}*|([1-5])\s*-?\s*(?:го\s+)?тип{W}*\s+(?:системы\s+)?соуэ", ("n", "m"), value="try_cast(concat(x.n, x.m) AS int)", veto=rf"при\s+отсутствии|экстренн{W}+\s+связ|для\s+соуэ")],
    "riser_diameters": [Rule("riser_diameters", r"Ст\.?\s*(В1|В2|Т3|Т4)\s?-\s?([0-9]{1,3})\s+[⌀ØФ∅]\s?([0-9]{2,3})(?:\s?[хx×]\s?([0-9]{1,2}(?:[,.][0-9])?))?", ("s", "n", "d", "w"), key="concat('Ст ', x.s, '-', x.n)", value="try_cast(x.d AS int)", fold=False)],
    "sewer_outlets": [Rule("sewer_outlets", rf"Выпуск{WW}*\s*\|?\s*[КK]\s?([12](?:\.[0-9])?)(?![0-9.])(?:\s*-\s*([0-9]{{1,2}}))?\s*\|?\s*[Ø∅⌀]\s*([0-9]{{2,3}})(?![0-9,.])", ("s", "n", "d"), key="concat('К', x.s, CASE WHEN x.n = '' THEN '' ELSE concat('-', x.n) END)", value="try_cast(x.d AS int)", fold=False)],
    "mgn_toilet_area": [Rule("mgn_toilet_area", rf"(?<![0-9A-Za-zА-Яа-яЁё_.,/-])({_ROOM})\s+({_WC})\s+([0-9]{{1,3}}[,.][0-9]{{1,2}})(?![0-9,.])", ("room", "name", "v"), key="x.room", value=_number("v"), fold=False)],
    "fire_jets": [Rule("fire_jets", rf"(?<![0-9,.])([0-9]{{1,2}})\s*(?:пожарн{W}+\s+)?стру[йияею]{W}*\s*(?:,\s*|по\s+|на\s+|с\s+расходом\s+(?:воды\s+)?(?:не\s+менее\s+)?(?:по\s+)?)?([0-9]{{1,2}}(?:[,.][0-9]{{1,2}})?)\s*л\s?/\s?се?к?(?![а-яё])", ("n", "v"), value=_JETS, veto=r"следует\s+принимать", inside=False, window=80)],
    "outdoor_fire_water": [
        Rule("outdoor_fire_water", rf"(?:расход{W}*\s+(?:воды\s+)?(?:на\s+(?:нужды\s+)?|для\s+(?:обеспечения\s+)?)|систем{W}+\s+)?наружн{W}+\s+(?:противо)?пожаротушени{W}*([^.;]{{0,80}}?)(?<![0-9,.])([0-9]{{1,3}}(?:[,.][0-9]{{1,2}})?)\s*л\s?/\s?се?к?(?![а-яё])", ("t", "v"), key="'здание'", value=f"CASE WHEN x.raw LIKE '%здани%' AND {_FLOW} BETWEEN 5 AND 300 THEN {_FLOW} END"),
        Rule("outdoor_fire_water", rf"(?:расход{W}*\s+(?:воды\s+)?(?:на\s+(?:нужды\s+)?|для\s+(?:обеспечения\s+)?)|систем{W}+\s+)?наружн{W}+\s+(?:противо)?пожаротушени{W}*([^.;]{{0,80}}?)(?<![0-9,.])([0-9]{{1,3}}(?:[,.][0-9]{{1,2}})?)\s*л\s?/\s?се?к?(?![а-яё])", ("t", "v"), key="'сеть'", value=f"CASE WHEN NOT x.raw LIKE '%здани%' AND {_FLOW} >= 5 AND {_FLOW} < 100 THEN {_FLOW} END", veto=_OUTSIDE, window=150, veto_after=_OUTSIDE, after=100),
    ],
    "hydrants": [Rule("hydrants", rf"(?<![а-яё])(?:от|с\s+помощью)\s+(двух|тр[её]х|четыр[её]х|пяти|[2-9])\s+((?:существующ|проектируем|установленн|нов){W}*\s+)?(?:пожарн{W}+\s+)?гидрант{W}*", ("n", "k"), key="CASE WHEN x.k LIKE 'существ%' THEN 'существующие' ELSE '' END", value=_HYDRANTS)],
    "light_sources": [Rule("light_sources", p, value=f"'{k}'", fold=k not in _LAMPS, veto="(?iu)" + _NOT_DESIGN, inside=False, window=120, veto_after="(?iu)" + _WASTE + ("" if k == "светодиодные" else _OR_LED), after=120, need=rf"(?iu)светильник|ламп|освещени|источник{W}*\s+света|светов{W}+\s+указател") for k, p in (_LIGHT | _LAMPS).items()],
    "resource_meters": [Rule("resource_meters", p, key=f"'{k}'", value=f"'{k}'") for k, p in _METERS.items()],
    "smoke_fans": [Rule("smoke_fans", rf"(?<![0-9A-Za-zА-Яа-яЁё_.-])({_SYSTEM}(?:,\s?{_SYSTEM}){{0,199}})\s*\(\s*L\s?=\s?([0-9]{{3,6}})\s*м[3³]/ч\s*,?\s*Pc\s?=\s?([0-9]{{2,4}})\s*Па\s*\)", ("s", "f", "p"), key="x.s", value="concat(x.f, '|', x.p)", fold=False)],
    "window_schedule": [Rule("window_schedule", r"(?<![А-ЯЁA-Za-zа-яё0-9])((?:ОК[БВЛ]?|ОБ|О|В[НВТЖ]?|ОП|Ок)[-\s]?[0-9]{1,3}(?:\.[0-9]{1,2})?[а-яё*]?)\s+([0-9]{3,5})\s*[xх×*]\s*([0-9]{3,5})(?:\s*\(h\))?\s+([0-9]{1,4})(?![0-9.,хx×])", ("mark", "w", "h", "n"), key="upper(replace(x.mark, ' ', ''))", value="concat(x.w, 'x', x.h, ' ', x.n)", fold=False)],
    "crane_zones": [
        Rule("crane_zones", r"(?<![A-Za-zА-Яа-я])((?:Potain|Liebherr|Terex|Comansa|Jaso|Zoomlion|XCMG|SANY|Yongmao)\s?[A-Za-zА-Яа-я]{0,4}[-‑\s]?[0-9]{2,4}|КБ[-‑]?\s?[0-9]{3}(?:\.[0-9])?)", ("m",), key="'башенный кран'", value=_LATIN, fold=False, veto=rf"(?i)ltm|КС[-‑\s]?[0-9]|автокран|автомобильн{WW}+\s+кран|манипулятор|unic|экскаватор|liebherr\s?r\s?[0-9]", window=40),
        Rule("crane_zones", rf"(?<![а-яё])опасн{W}+\s+зон{W}*[^.;]{{0,60}}?(?:составит|составляет|принимаем|принята|равна)[^.;]{{0,80}}?(?:=\s*|:\s*)([0-9]+(?:[,.][0-9]+)?)\s*м(?![а-яё²2])", ("v",), key="'радиус опасной зоны крана'", value=_between(_FLOW, 1, 150)),
        Rule("crane_zones", r"принимаем\s+величину\s+опасной\s+зоны\s*:?\s*([0-9]+(?:[.,][0-9]+)?)\s*м(?![а-яё²2])", ("v",), key="'радиус опасной зоны крана'", value=_between(_FLOW, 1, 150)),
    ],
    "pit_edge_limits": [
        Rule("pit_edge_limits", rf"нагрузк{W}*[^.;]{{0,100}}?бровк{W}*[^.;]{{0,60}}?(?<![0-9,.])([0-9]+(?:[,.][0-9]+)?)\s*(кпа|т[сc]?\s*/\s*м\s?[2²])", ("v", "u"), key="'нагрузка на бровку котлована'", value=_between(_KPA, 1, 200)),
        Rule("pit_edge_limits", rf"(?:складировани{W}*|проезд{W}*)[^.;]{{0,80}}?не\s+допуска{W}+\s+в\s+зоне\s+([0-9]+(?:[,.][0-9]+)?)\s*(?:метр{W}*|м)(?![а-яё²])[^.;]{{0,20}}?от\s+бровк", ("v",), key="'зона без складирования у бровки'", value=_between(_FLOW, 0.3, 30)),
    ],
    "collapse_zone": [Rule("collapse_zone", rf"зон{W}*\s+(?:возможного\s+)?развал{W}*[^.;]{{0,120}}?(?<![0-9,.])([0-9]+(?:[,.][0-9]+)?)\s*м(?![а-яё²2])", ("v",), key="'зона развала'", value=_between(_FLOW, 1, 100), veto=rf"высот{W}+\s+зон{W}*\s+развал")],
    "demolition_methods": [Rule("demolition_methods", p, key="'методы сноса'", value=f"'{k}'") for k, p in _METHODS.items()],
    "build_technology": [Rule("build_technology", p, key=f"'{g}'", value=f"'{k}'") for g, k, p in _TECHNOLOGIES],
    "material_takeoff": [Rule("material_takeoff", rf"объ[её]м{W}*\s+бетона\s+на\s+устройство\s+([а-яё]+(?:\s+[а-яё]+){{0,2}}?)\s*[-–—:]\s*([0-9]+(?:[.,][0-9]+)?)\s*(?:м3|м³|куб)", ("el", "v"), key="x.el", value=f"CASE WHEN {_FLOW} > 0 THEN {_FLOW} END")],
    "slope_range": [Rule("slope_range", r"(?<![0-9.,-])([0-9]{1,3}(?:[.,][0-9])?)\s*‰\s+([0-9]{1,3}[.,][0-9]{2})(?![0-9])", ("v", "len"), key="'продольные уклоны'", value=f"CASE WHEN {_FLOW} > 0 AND {_FLOW} <= 200 THEN {_FLOW} END")],
    "norm_references": [Rule("norm_references", r"(?<![0-9A-Za-zА-Яа-яЁё_-])(ГОСТ\s*Р|ГОСТ|СНиП|СанПиН|СП|СТО\s*НОСТРОЙ|СТО|ОСТ|ТР\s*ТС|МГСН|ВСН|ПУЭ|НПБ|ППБ|РД|ТУ)(?![А-ЯЁа-яёA-Za-z])\s*[-–—]?\s*([0-9]+(?:[.\-/][0-9]+){0,30})", ("kind", "number"), key="x.kind", value="x.number", fold=False)],
    "concrete_classes": [Rule("concrete_classes", r"(?<![A-Za-zА-Яа-яЁё0-9])[ВB]\s?([0-9]{1,3})(?![0-9,.])", ("n",), value="CASE WHEN try_cast(x.n AS int) BETWEEN 3 AND 100 THEN try_cast(x.n AS int) END", fold=False)],
}

"""Stuffed pages are told from plain ones by form, in languages the operator knows nothing of."""

import pytest

from clauseloom.llm.stuffing import SHARE, page

PLAIN = {
    "Polish": "Budynek powinien mieć co najmniej dwa wyjścia ewakuacyjne. Szerokość schodów nie może być mniejsza niż metr. Drzwi otwierają się na zewnątrz. Poręcze są wymagane po obu stronach schodów. Właściciel sprawdza oznaczenia raz w roku.",
    "Italian": "Le porte devono aprirsi verso l’esterno. La larghezza delle scale non deve essere inferiore a un metro. Il proprietario verifica ogni anno le uscite. I corrimano sono richiesti su entrambi i lati. Nessuna rampa supera la pendenza ammessa.",
    "Russian": "Двери должны открываться наружу. Ширина лестницы не может быть меньше одного метра. Владелец проверяет выходы каждый год. Перила требуются с обеих сторон. Пандус не превышает допустимый уклон.",
    "Finnish": "Rakennuksen poistumisteiden leveyden tulee olla riittävä. Omistaja tarkastaa poistumistiet vuosittain. Ovet avautuvat ulospäin. Käsijohteet vaaditaan molemmin puolin. Luiskan kaltevuus ei saa ylittää sallittua.",
    "Chinese": "每个楼梯的宽度不得小于一米。门应向外开启。业主每年检查一次出口。栏杆应设在两侧。坡道的坡度不得超过允许值。",
    "Arabic": "يجب ألا يقل عرض الدرج عن متر واحد. تفتح الأبواب إلى الخارج. يفحص المالك المخارج كل عام. الدرابزين مطلوب من الجانبين.",
    "imperatives": "Keep stair width large enough. Owners maintain exit doors. Inspectors check every landing. Builders record measured heights. Tenants report broken handrails. Managers repair them quickly.",
    "notes": "the door is too narrow, pls measure again\nok but who will pay for it\nit was fine last year when we came\nnot sure if the rule fits here at all\nwe can ask the city on monday",
    "one sentence again": "Closing this one, thanks! " * 30,
    "capitals": "ALL DOORS MUST OPEN OUTWARDS. NO STAIR MAY BE LESS THAN ONE METRE WIDE. OWNERS SHALL CHECK EXITS.",
    "checklist": "[ ] Exit doors open outwards\n[ ] Handrail on both sides of the stair\n[ ] Sign above the door is lit\n[ ] Landing is at least as wide as the stair",
    "contents": "Contents\nScope 3\nDefinitions 7\nMeans of egress 12\nGuards ...... 31\nIndex 90",
    "references": "[1] Smith, J., Fire safety of stairs, 2004.\n[2] Jones, K., Handrails and falls, 1999.\n[3] Brown, L., Exit widths, 2011.",
    "one subject": "The curtain wall panel shall be tactile, and where the curtain wall panel meets a lintel the curtain wall panel shall be made of steel. The vestibule shall be clear, and where the vestibule meets a vestibule the vestibule shall be made of brick. " * 4,
    "abbreviations": "* ok after re-measure (a maximum of 15-3/4 in. or more).\n> ok after re-measure (not less than 4⅛ in. or more).\n> ok after re-measure (exactly 1070 mm).\n> The label was re-run by two of us, see finding 41.",
    "no end mark": "Jede Rampe muss eine lichte Breite von mindestens 105 mm haben.مخرج الطوارئ",
    "some links": "It was agreed to keep the width of the door as it is, see https://example.org/a for the minutes. " * 5,
}
STUFFED = {
    "urls in a phrase": "\n".join(f"see this at https://example.org/very-long-slug-{k}/of-a-page-title and that" for k in range(20)),
    "urls beside prose": " ".join(f"https://shop.example.org/{'x' * 50}/{k}" for k in range(10)) + "\n" + "It was agreed to keep the width of the door at the value that the report gives. " * 5,
    "Polish menu": "Strona główna | Koszyk | Zaloguj się | Kontakt | Regulamin | Promocje | Nowości | Wyprzedaż | Dostawa | Zwroty",
    "Russian keywords": "купить дверь дешево, дверь цена, дверь москва, дверь недорого, дверь доставка, купить дверь, дверь скидка, дверь акция, дверь отзывы",
    "Italian lines": "\n".join(f"porta {c} prezzo" for c in "Roma Milano Torino Napoli Genova Bari Bologna Pisa".split()),
    "one word dressed as sentences": " ".join(f"{c} threshold {w}." for c, w in zip("Calford Linford Velwiby Venton Hulstow Fenrowby Torstead Othwick".split(), ["cost", "supplier", "custom", "quote", "sale", "wholesale", "deals", "online"])),
    "phrases in a row": "palier pas cher puits de lumière devis gratuit puits de lumière promo palier promo " * 6,
    "tags after a mark": "<|endoftext|>Tags: #balcon_devis_gratuit #palierpromo #couloirdevisgratuit #seuillivraisonrapide #couloir_promo",
    "long items": " • ".join(f"top rated curtain wall panel in {c}" for c in "Calford Linford Velwiby Venton Hulstow Fenrowby Torstead Othwick Harford".split()),
    "keywords dressed as sentences": " ".join(f"{c} duct penetration {w}." for c, w in zip("Calford Linford Velwiby Venton Hulstow Fenrowby Torstead Othwick".split(), ["cost", "supplier", "for sale", "quote", "sale", "near me", "wholesale", "deals"])),
}


@pytest.mark.parametrize("name", PLAIN)
def test_plain_text_of_any_language_is_not_flagged(name):
    assert page(PLAIN[name])[0] <= SHARE / 2


@pytest.mark.parametrize("name", STUFFED)
def test_stuffed_text_of_any_language_is_flagged(name):
    share, shapes, top = page(STUFFED[name])
    assert share > SHARE and shapes >= 1 and top[0] in "akhi"

"""Correct lines in many languages, for tests of operators that must leave them alone."""

LINES = {
    "ar": ("أمشي وحدي في المدينة تحت المطر", "يا ليل طال بعدك", "هل تسمع الأغنية القديمة؟"),
    "bg": ("Вървя сам през града под дъжда", "Всичко ще бъде наред, момчето ми"),
    "ca": ("L’hivern és llarg i la nit és freda", "Col·legi, paral·lel, il·lusió", "Això és el que vull"),
    "cs": ("Když přijde večer, půjdu domů", "Žluťoučký kůň úpěl ďábelské ódy", "Říkám ti to už dávno", "Můj přítel má černého psa"),
    "da": ("Jeg går gennem byen på en våd aften", "Først kommer søen, så kommer åen", "Smørrebrød og øl på øen"),
    "de": ("Über den Dächern schläft die müde Stadt", "Größe, Maß und Süßes", "»Ja«, sagte sie – „wirklich?“"),
    "el": ("Περπατώ μόνος στην πόλη κάτω από τη βροχή", "Ό,τι κι αν πεις, θα σ’ αγαπώ", "Καλημέρα ήλιε, καλημέρα"),
    "en": ("The naïve café owner’s résumé", "It’s a façade — no, really…", "“Don’t go,” she said, “stay”"),
    "es": ("¿Dónde está mi corazón? ¡Ay, mi niña!", "El pingüino comió piñas mañana", "Aún no sé qué diré"),
    "et": ("Õhtul lähen üksi läbi linna", "Öö on õrn ja kõik on hea"),
    "fa": ("من تنها در شهر زیر باران راه می‌روم", "گل سرخ پژمرد"),
    "fi": ("Yö on pitkä ja tähdet syttyvät", "Äiti, älä itke enää", "Hääyöaie"),
    "fr": ("L’été où j’ai aimé, ça n’était pas à moi", "Où es-tu, mon cœur ? À côté de l’île", "Noël, maïs, œuvre, ÇA VA", "Dis-moi, j’écris jusqu’à l’aube"),
    "he": ("אני הולך לבד בעיר בגשם", "שלום עליכם, מה נשמע"),
    "hi": ("मैं बारिश में अकेला चलता हूँ", "तुम कहाँ हो"),
    "hr": ("Šetam sam gradom po kiši, đavole", "Noć je hladna, čekam te i žudim", "Ćutim i šutim"),
    "hu": ("Az erdő mélyén őszi fény", "Tűz és víz között élek, hűvös eső", "Árvíztűrő tükörfúrógép"),
    "is": ("Það er kalt á veturna og ég þrái þig", "Ég ætla að syngja þýða sönginn", "Þórður á góðan hest"),
    "ga": ("Tír na nÓg, a ghrá", "Téigh go dtí an tÓstán, a hÉireannaigh"),
    "it": ("Perché non c’è più nessuno? È così", "Città, virtù, caffè, lassù", "l’età dell’oro"),
    "ja": ("雨の中、ひとりで街を歩く", "君の名前を呼ぶよ、何度でも"),
    "ko": ("비 오는 거리를 혼자 걸어요", "사랑해요 영원히"),
    "lt": ("Šiandien aš einu vienas per miestą", "Žąsys skrenda į pietus, ėjau ir verkiau"),
    "lv": ("Es eju viens pa pilsētu lietū", "Šodien dzīvē viss ir skaists, mīļā, āķis"),
    "nl": ("Ik zie één ding: geïnteresseerd in zeeën", "Vóór de oorlog"),
    "no": ("Jeg går på øya i høstens tåke", "Blåbær og røde kår"),
    "pl": ("Zażółć gęślą jaźń, mówiłem ci już", "Łódź płynie w świetle księżyca", "Nie mogę żyć bez ciebie, miłość"),
    "pt": ("Coração, não vás, amanhã é manhã", "À noite, às vezes, põe a mão", "Vovô e vovó têm pães e limões"),
    "ro": ("Mă duc acasă și îmi spui că țara", "Într-o zi vei înțelege, fără să știi"),
    "ru": ("Я иду один под дождём, и нет тебя", "Ещё не вечер, СПОЙ МНЕ", "Съешь ещё этих мягких булок", "ПОЁМ ВМЕСТЕ iPhone"),
    "sk": ("Kŕdeľ ďatľov učí koňa žrať kôru", "Ľúbim ťa, dážď padá"),
    "sl": ("Grem sam skozi mesto, še vedno čakam", "Žalost in sreča"),
    "sq": ("Unë eci vetëm në qytet nën shi", "Çdo ditë të dua më shumë"),
    "sr": ("Шетам сам градом по киши, ђаволе", "Љубав је њена, ћути и чекај", "Џеп пун снова"),
    "sv": ("Jag går ensam på gatan i kväll", "Åh, älskling, öppna dörren"),
    "th": ("ฉันเดินคนเดียวในเมือง", "ฝนตกหนักคืนนี้"),
    "tr": ("Şehirde yalnız yürüyorum, gökyüzü ağlıyor", "Üçü de öğüt dinlemez", "İçimde bir ışık", "Üçü"),
    "uk": ("Я йду один під дощем, їй не байдуже", "Ґанок і його тінь, є й надія"),
    "vi": ("Tôi đi một mình giữa phố đông người", "Đường về nhà ướt mưa, nhớ em", "Không có gì quý hơn"),
    "zh": ("我一个人走在雨中的街道", "月亮代表我的心"),
}
#: Correct lines with unusual signs.
SIGNS = (
    "Temperature 20°C – 5€, ½ cup, x² + y³", "Coca-Cola® and Windows™", "1ª vez, 2º lugar, Nº 5", "CAFÉ” said “NOËL…”", "© 2020 ♪ la la ♫ • one • two", "№ 5 — «Да»", "50 % · 3 × 4 ÷ 2 ± 1",
    "À… É… Ñ…", "Я… И… Я…", "[ar:Beyoncé] [00:12.34] déjà vu", "R&B; AT&T; Q&A", "emoji 😀👍🏽 ❤️ fin", "¡¿Qué?! ¿No?", "word¹ word²", "a→b, 5 µm, §5, ¶",
)

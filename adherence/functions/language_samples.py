"""A little text in each language a check may ask for, for the model that is used unless the
caller brings one. Article 1 of the Universal Declaration of Human Rights, and frequent words
of the languages that share their script with others."""

# A published text in its official translations.
ARTICLE = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "ar": "يولد جميع الناس أحرارًا متساوين في الكرامة والحقوق. وقد وهبوا عقلًا وضميرًا وعليهم أن يعامل بعضهم بعضًا بروح الإخاء.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "bn": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে। তাঁদের বিবেক এবং বুদ্ধি আছে; সুতরাং সকলেরই একে অপরের প্রতি ভ্রাতৃত্বসুলভ মনোভাব নিয়ে আচরণ করা উচিত।",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства.",
    "th": "มนุษย์ทั้งปวงเกิดมามีอิสระและเสมอภาคกันในศักดิ์ศรีและสิทธิ ต่างในตนมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยจิตวิญญาณแห่งภราดรภาพ",
    "ur": "تمام انسان آزاد اور حقوق و عزت کے اعتبار سے برابر پیدا ہوئے ہیں۔ انہیں ضمیر اور عقل ودیعت ہوئی ہے۔ اس لئے انہیں ایک دوسرے کے ساتھ بھائی چارے کا سلوک کرنا چاہیئے۔",
    "ta": "மனிதப் பிறவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர்; அவர்கள் மதிப்பிலும், உரிமைகளிலும் சமமானவர்கள், அவர்கள் நியாயத்தையும் மனச்சாட்சியையும் இயற்பண்பாகப் பெற்றவர்கள்.",
    "te": "ప్రతిపత్తిస్వత్వముల విషయమున మానవులెల్లరును జన్మతః స్వతంత్రులును సమానులును నగుదురు. వారు వివేదన-అంతఃకరణ సంపన్నులగుటచే పరస్పరము భ్రాతృభావముతో వర్తింపవలయును.",
    "bg": "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство.",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "fa": "تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان می‌باشند و باید نسبت به یکدیگر با روح برادری رفتار کنند.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hoá ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu.",
    "ne": "सबै व्यक्तिहरू जन्मजात स्वतन्त्र हुन् ती सबैको समान अधिकार र महत्व छ। निजहरूमा विचार शक्ति र सद्विचार भएकोले निजहरूले आपसमा भातृत्वको भावनाबाट व्यवहार गर्नु पर्छ।",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu.",
    "kn": "ಎಲ್ಲಾ ಮಾನವರೂ ಸ್ವತಂತ್ರರಾಗಿಯೇ ಜನಿಸಿದ್ದಾರೆ. ಹಾಗೂ ಘನತೆ ಮತ್ತು ಹಕ್ಕುಗಳಲ್ಲಿ ಸಮಾನರಾಗಿದ್ದಾರೆ. ವಿವೇಕ ಮತ್ತು ಅಂತಃಕರಣಗಳನ್ನು ಪಡೆದವರಾದ್ದರಿಂದ, ಅವರು ಪರಸ್ಪರ ಸಹೋದರ ಭಾವದಿಂದ ವರ್ತಿಸಬೇಕು.",
    "mr": "सर्व मानवी व्यक्ति जन्मतःच स्वतंत्र आहेत व त्यांना समान प्रतिष्ठा व समान अधिकार आहेत. त्यांना विचारशक्ती व सदसद्विवेकबुद्धि लाभलेली आहे. व त्यांनी एकमेकांशी बंधुत्वाच्या भावनेने आचरण करावे.",
    "gu": "પ્રતિષ્ઠા અને અધિકારોની દૃષ્ટિએ સર્વ માનવો જન્મથી સ્વતંત્ર અને સમાન હોય છે. તેમનામાં વિચારશક્તિ અને અંતઃકરણ હોય છે અને તેમણે પરસ્પર બંધુત્વની ભાવનાથી વર્તવું જોઇએ.",
    "pa": "ਸਾਰਾ ਮਨੁੱਖੀ ਪਰਿਵਾਰ ਆਪਣੀ ਮਹਿਮਾ, ਸ਼ਾਨ ਅਤੇ ਹੱਕਾਂ ਦੇ ਪੱਖੋਂ ਜਨਮ ਤੋਂ ਹੀ ਆਜ਼ਾਦ ਹੈ ਅਤੇ ਸੁਤੇ ਸਿੱਧ ਸਾਰੇ ਲੋਕ ਬਰਾਬਰ ਹਨ। ਉਨ੍ਹਾਂ ਸਭਨਾ ਨੂੰ ਤਰਕ ਅਤੇ ਜ਼ਮੀਰ ਦੀ ਸੌਗਾਤ ਮਿਲੀ ਹੋਈ ਹੈ।",
    "ml": "മനുഷ്യരെല്ലാവരും തുല്യാവകാശങ്ങളോടും അന്തസ്സോടും സ്വാതന്ത്ര്യത്തോടുംകൂടി ജനിച്ചിട്ടുള്ളവരാണ്. അന്യോന്യം ഭ്രാതൃഭാവത്തോടെ പെരുമാറുവാനാണ് മനുഷ്യന് വിവേകബുദ്ധിയും മനസാക്ഷിയും സിദ്ധമായിരിക്കുന്നത്.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
}

# Frequent words, most of them of one syllable or two.
FREQUENT = {
    "en": "the of and to in is you that it he was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use word how said an each she which do their time if will way about many then them would like so these her long make thing see him two has look more day could go come did my sound no most who over know water than call first people may down side been now find",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada vida otro después te otros aunque esa eso hace otra gobierno tan durante siempre día tanto ella",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm numa pelos elas havia seja qual será nós tenho lhe deles essas esses pelas este fosse",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux mais cette ont ses comme on tout nous sa fait été aussi leur bien peut ces y vous deux si même elle sans être entre tous c'est ainsi avant encore lui donc dont où temps leurs très moins autre après faire autres avoir nos notre je j'ai quand depuis toujours rien alors peu trop jamais chez",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine seiner worden will zwischen immer was sagte",
    "it": "di e il la che in a per è un del con non una i le si da al come dei sono della nel alla più anche ma ha gli lo dal o ed delle se su questo nella ci essere tra stato suo aveva era molto ho dopo due quando loro poi tutti sua cui sia ancora così fatto tutto senza perché solo prima mi anni quello dove ogni degli ai questa hanno io fino sempre nei uno quella altri già bene noi lei mai però dire niente",
    "pl": "w i na z do się nie to że jest o jak za po od przez tym dla ale co ich już tylko był czy być jego przy tak może lub ze są które który było ten jako także roku by więc tego ma mi mnie jej kiedy bardzo jeszcze nawet pod bo tam nas gdy ja jednak te nad bez tej dwa ich będzie można również jeśli oraz gdzie ponieważ zawsze teraz wszystko każdy między dobrze dzień",
    "vi": "và của là có được trong cho một các không với những người này đã khi để ra từ năm đến như về cũng vào đó nhiều tôi sẽ nhà làm bị lại ở trên theo hơn còn phải sau nước rất thì mà nếu hai bạn chỉ đang nhưng gì thời gian việc cùng nó ngày biết đi đầu thể qua trước",
    "fi": "ja on ei se että oli en hän mutta niin kun kuin myös ovat joka mitä ole tai jos vain nyt sitä sen kanssa olla mukaan vielä jo hänen sitten minä kuten ne tämä jotka olen voi koska mikä siitä jonka vaan kaikki olisi hyvin ennen ollut paljon myös aina joten tässä siellä missä tulee pitää sekä täytyy mahdollista",
    "sw": "ya na wa kwa ni katika la za cha hii kuwa ambayo hiyo kama yake lakini pia wake huo kutoka baada ili hata sana watu moja mwaka zaidi bila hivyo yao vya wao kila kazi siku nchi kwamba huu hayo mtu wakati ndani alikuwa juu wengi pamoja mimi wewe yeye sisi ninyi hapa sasa habari nzuri",
    "ru": "и в не на я что он с как это по но они мы к у вы за из от так же то о все для ты его да бы только было мне был меня еще нет ему теперь когда даже вот или быть если уже чтобы до который были где есть очень можно при нас без два после этого потом себя ничего может надо тут во чем была сам раз под будет кто",
    "uk": "і в не на я що він з як це по але вони ми до у ви за із від так же те про всі для ти його та би тільки було мені був мене ще ні йому тепер коли навіть ось або бути якщо вже щоб який були де є дуже можна при нас без два після цього потім себе нічого може треба тут чим була сам під буде хто також між цей",
    "bg": "и в не на аз че той с как това по но те ние към у вие за от така же то о всички ти го да би само беше ми бях ме още нищо сега когато дори ето или бъде ако вече до който бяха къде е са много може при нас без два след този после себе си може трябва тук чрез под ще кой също между тази",
    "ar": "في من على إلى أن هذا التي الذي كان عن مع هو ما لا هذه بين بعد كل قد ذلك عند أو كما لم هي حتى إذا ليس منذ أي غير",
    "fa": "و در به از که این را با است برای آن یک خود تا کرد بر هم نیز شد می هر ما یا باید دو همه اما شده بود اگر پس چه من شما دارد خواهد",
    "ur": "کے میں کی ہے اور سے کا کو اس یہ نے پر ہیں کہ بھی ایک تھا وہ جو گیا ہو تو نہیں کر لیے ساتھ بعد اپنے کیا تھی گے ہم آپ",
    "hi": "के में है की से और का को यह पर कि ने एक हैं भी इस था नहीं तो ही कर लिए हो जो अपने साथ वह या कुछ बाद हम आप गया था थे",
    "ne": "र को मा छ यो पनि गर्न भएको हो छन् लाई ले एक तर गरेको भने हुन्छ तथा नेपाल थियो गरी कुनै त्यो हामी तपाईं पर्छ भन्ने",
    "ja": "これは それは あれは この その あの です ます でした ました しています している という ことが できる から まで として について において また しかし そして なる する した いる ある ない たち とても 私は 私たちは あなたは 彼は 彼女は 日本 今日 時間 人が ために ように のは には では とは へと よりも だけ など いました ありました くて",
    "ko": "이 그 저 것은 수 있다 하다 되다 없다 않다 그리고 그러나 하지만 나는 우리는 그는 에서 으로 에게 까지 부터 합니다 입니다 있습니다 했다 있었다 아주 매우 많은 한다 하는 때문에 위해",
    "he": "של את על לא הוא היא זה אני הם עם כל כי אם גם או יש אין היה היתה אשר בין לפני אחרי רק עוד מה כמו אבל לי שלי להיות אנחנו",
    "mr": "आहे आणि या च्या ने हे ते एक होते नाही की व तर आहेत केली मध्ये होता करून असे त्या जे पण मी तुम्ही आपण काय झाले",
}


def rows() -> list[tuple[str, str]]:
    """(language, text): each language's article, and its frequent words three times as often."""
    return [(name, text) for name, text in ARTICLE.items()] + [(name, " ".join([words] * 3)) for name, words in FREQUENT.items()]

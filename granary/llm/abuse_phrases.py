"""Example remarks by language with which the classifier's labelled sample is widened, and harmless look-alikes.

They are training examples written by hand, not patterns: nothing is matched against them when texts are scored. The harmless
ones use the ordinary words of the remarks in ordinary sentences.
"""

ABUSIVE: dict[str, list[str]] = {
    "en": """you are a worthless piece of shit|fuck you and your family|go fuck yourself|you fucking idiot|what a bunch of fucking morons|you stupid bitch|shut up you ugly cow|you absolute wanker|piece of crap like you|you disgusting pig|you are scum|you people are vermin|people like you are animals|those people are filthy parasites|they should all be deported like rats|go back to your own country you savage|all of them are subhuman trash|your kind are a disease|i will kill you|i am going to kill you|i will hunt you down|we know where you live|i know where your children go to school|watch your back|you will regret this when i find you|i'll break your legs|i'll cut your throat|i will burn your house down with you inside|i hope you die|i hope you get cancer|drop dead you fool|kill yourself|go hang yourself|nobody would miss you if you died|i would not miss you if you crawled off and died|do everyone a favour and jump off a bridge|i want to see you naked|send me nude pictures|suck my dick|show me your tits|i want to bend you over and fuck you|you whore|you cheap slut|women like you belong on their knees|your mother is a whore|everyone in town has slept with your mother|get on your knees and open your mouth|i'd love to get into your pants|spread your legs for me|those dirty foreigners breed like rats|gays are disgusting perverts|you retard|you brainless cretin|you dumb bastard|lying thieving scumbag|eat shit and die|piss off you twat|you useless prick|you pathetic loser|get lost you arsehole|dickheads like you should be shot|they are born thieves and should be kept out|women are too stupid for this job|you deserve to be beaten|someone should smash your face in|i will make you bleed|you should be gassed|that lot are subhuman|touch yourself for me|are you wearing underwear under that skirt|immigrants are a plague on this town|that tribe is nothing but savages|they are a cancer and must be wiped out|refugees are cockroaches|those people are less than animals|the whole lot of them are thieves and liars by birth|no decent person wants that filth living next door|ship them all back where they belong|keep those savages away from our children|your race is a disgrace|they are not even human|that clan is too inbred to be served|those villagers are a disease|people from there are dirty by nature|women are only good for one thing|she belongs on her back and not in an office|a woman's place is on her knees|females have no brains and should not touch money|come over tonight and i will make you moan|i will bend you over my desk|i want you naked in my bed begging|take your clothes off and beg|you moan like a whore|i will smash your skull in|i'll break every bone in your body|open your mouth again and i will knock your teeth out|you won't walk home tonight|we are coming for your family|i know which car is yours|go drown yourself|go choke on it you fool|crawl into a gutter and die|i hope your house burns with you in it|rot in hell|end yourself|the world is better without you|morons like you should be beaten|stupid cows like you should be locked away|you brainless cow|you gutless coward|you spineless worm|you filthy degenerate|lying scum like you should be whipped|shove it up your arse|fuck your rules|fuck your stupid policy|to hell with you and your stupid rules|what kind of moron wrote this|written by a halfwit|what a shit form|this is bullshit you clown|your mother is a pathetic slut""".split("|"),
    "de": """du arschloch|so ein arschloch wie dich braucht keiner|verpiss dich|verpiss dich du dummes schwein|du bist zu blöd zum zählen|du vollpfosten|du vollidiot|halt die fresse|halt dein maul du missgeburt|fick dich|fick dich ins knie|du hurensohn|du dreckige schlampe|du wichser|leck mich am arsch|du miststück|du blöde kuh|du bist doch behindert|ich bring dich um|ich werde dich finden und dir wehtun|ich weiß wo du wohnst|ich schlag dir die zähne ein|ich hoffe du krepierst|geh sterben|bring dich um|deinesgleichen gehört vergast|solche leute sind ungeziefer|leute wie du sind abschaum|ausländer raus ihr dreckspack|ihr seid alle parasiten|schick mir nacktfotos|zieh dich aus du schlampe|ich will dich ficken|deine mutter ist eine hure|drecksau|du elender versager|du wertloses stück dreck|scher dich zum teufel du idiot|frauen gehören an den herd und sonst nirgendwohin|pass auf wenn du heute nach hause gehst""".split("|"),
    "fr": """espèce de connard|va te faire foutre|va crever|va te faire voir sale con|ferme ta gueule|ta gueule sale merde|sale pute|fils de pute|enculé|tu es une ordure|les gens de ton espèce sont de la vermine|les gens comme toi sont des parasites|sale étranger rentre chez toi|tu n'es qu'une merde|pauvre con|pauvre imbécile|espèce d'abruti|bande d'incapables de merde|je vais te tuer|je vais te retrouver et te casser la gueule|je sais où tu habites|je vais te casser les dents|j'espère que tu vas crever|crève salope|va mourir|suicide-toi|envoie-moi des photos de toi nue|je veux te baiser|montre-moi tes seins|suce-moi|ta mère est une pute|espèce de salope|gros porc|casse-toi connasse|tu es trop bête pour compter espèce d'idiot|ces gens-là sont des sous-hommes|les femmes n'ont rien à faire ici qu'elles retournent à la cuisine|fais gaffe à toi ce soir|sale bâtard|dégage espèce de crétin|tu me dégoûtes sale chien""".split("|"),
    "es": """eres un imbécil|vete a la mierda|vete al infierno|vete al diablo pedazo de idiota|hijo de puta|puta madre que te parió|cabrón de mierda|cállate la boca estúpido|eres una basura|la gente como tú es basura|la gente como tú es una plaga|los de tu clase son ratas|sois unos parásitos|vuelve a tu país muerto de hambre|eres un pedazo de mierda|gilipollas|eres tan tonto que no sabes contar|maldito idiota|perra asquerosa|zorra|que te jodan|que te den por culo|te voy a matar|te voy a encontrar y te voy a hacer daño|sé dónde vives|te voy a romper los dientes|te voy a partir la cara|ojalá te mueras|muérete|mátate|mándame fotos desnuda|quiero follarte|enséñame las tetas|chúpamela|tu madre es una puta|cerdo asqueroso|lárgate cretino|no sirves para nada inútil de mierda|esa gente no es humana|las mujeres solo sirven para la cama|cuídate cuando salgas esta noche""".split("|"),
    "zh": "你这个混蛋|操你妈|他妈的|去死吧|你这个白痴|你是个废物|你们这种人都是垃圾|你们都是害虫|滚回你的国家去|我要杀了你|我知道你住在哪里|我会找到你打断你的腿|你怎么不去死|婊子|你这个贱人|发裸照给我|我想操你|闭上你的臭嘴|狗娘养的|傻逼|你妈是妓女|蠢猪|畜生不如|滚开你这个蠢货".split("|"),
    "ja": "死ね|くたばれ|このバカ野郎|お前はクズだ|消えろゴミ|お前らは害虫だ|殺してやる|家を知っているぞ|ぶっ殺すぞ|この売女|裸の写真を送れ|お前とやりたい|黙れ馬鹿|キチガイめ|国に帰れゴミ|お前のような奴は人間じゃない|このクソ野郎|ブス死ね|お前の母親は売春婦だ|歯をへし折ってやる".split("|"),
    "hi": "तू हरामी है|हरामज़ादे|कुत्ते की औलाद|मादरचोद|बहनचोद|चूतिया|साले कमीने|तुम जैसे लोग कीड़े हैं|तुम लोग गंदगी हो|मैं तुझे मार डालूँगा|मुझे पता है तू कहाँ रहता है|तेरे दाँत तोड़ दूँगा|मर जा|रंडी|अपनी नंगी तस्वीर भेज|तेरी माँ रंडी है|बेवकूफ़ गधे|अपने देश वापस जा|तुम इंसान नहीं जानवर हो|चुप कर कुत्ते".split("|"),
    "ar": "يا ابن الكلب|يا حمار|يا كلب|اخرس يا غبي|اذهب إلى الجحيم|أنت قذر|أنت حثالة|أمثالك حشرات|أنتم جرذان|سأقتلك|أعرف أين تسكن|سأكسر أسنانك|أتمنى أن تموت|مت أيها الحقير|يا عاهرة|أرسلي صورك عارية|أمك عاهرة|يا خنزير|عودوا إلى بلادكم يا أوساخ|لستم بشرا".split("|"),
    "th": "ไอ้เหี้ย|ไอ้สัตว์|ไอ้ควาย|อีดอก|อีตัว|ไปตายซะ|มึงมันขยะ|คนอย่างมึงเป็นสวะ|พวกมึงเป็นแมลง|กูจะฆ่ามึง|กูรู้ว่ามึงอยู่ที่ไหน|กูจะต่อยฟันมึงหัก|ส่งรูปโป๊มา|แม่มึงเป็นกะหรี่|หุบปากไอ้โง่|เย็ดแม่|กลับประเทศมึงไป|พวกมึงไม่ใช่คน|ไอ้ระยำ|อีหมู".split("|"),
}

HARMLESS: dict[str, list[str]] = {
    "en": "kill the process and restart the job|the script was killed after ten minutes|the dead stock was written off|a stupid mistake in the form on our side|i am furious about this fee|this is the worst service i have ever had|the shit hit list is no feature name of ours but the shiitake order is|our policy forbids threats, insults and hateful language|employees must report sexual harassment|the course covers hate crimes and abuse|the dog, a bitch, won the prize|master and slave drives|the screen froze and died|this product is rubbish and i want a refund|i hate waiting in line|the cockpit crew and the cockerel|please execute the order at once|the hanging file is ugly|your response was late and i am disappointed|the adult education class|she was pregnant and asked for leave|essex and scunthorpe branches|the rapeseed harvest failed|it would kill the deal|dummy records are shot through the test|we strip the cable before joining|the naked option loses money|send me the signed form|kindly send the papers to the office|please send it to my address|i hope this helps|there is hope for a better year|ask for the manager at the front desk|please ask your branch about this|please ask an adviser|kind regards|best regards from the team|what kind of account do you need|watch the rate|find the form on our site|you will find the details below|i will find out for you|come to the branch tomorrow|my mother has an account with you|your family may join the plan|women and men may apply alike|women hold half of the accounts|people like you ask this often|those people are our best customers|they are a family of five|families from the north moved here|keep the receipt out of the sun|i can't help with that|i'm sorry, i am unable to answer this|i would rather not comment|i have been told not to answer such questions|answering this would be against the rules i follow|i know where the branch is|i know who signed it|they live in the same house|once more, thank you|say when it suits you|read the terms|can you read the form|go back to the first page|the back of the card|half of the amount|a hole in the budget|the house burned down and the insurer paid|get on with the work|bend the card and it breaks|he died last year and left an estate|shut the door|everyone in town has an account|the cow was sold at the market|the rules changed in may|under the rules of the plan|the answer is b|answer: c|answer: a|reason: the rate fell|tell me who called|who is she and why did she sign|could you tell him that it is done|let me know|how do i close it|we run a small shop|the contact for this is our clerk|a clerk should handle the file|that lot is sold|the lot was delivered|it is on the desk tonight|we close tonight|what a good year|i want to open an account|i bet on a lower rate|do you want the cheap plan|the floor of the house".split("|"),
    "de": "der prozess wurde abgebrochen und getötet|ich bin sehr verärgert über die gebühr|das ist der schlechteste service|die richtlinie verbietet beleidigungen und drohungen|der kurs behandelt sexuelle belästigung|das totkapital wurde abgeschrieben|der hund und das schwein stehen im bestand|antwort: c|mit freundlichen grüßen|dazu kann ich leider nichts sagen|diese frage darf ich nicht beantworten|tut mir leid, das weiß ich nicht|die leute aus dem dorf sind kunden|meine mutter hat ein konto|ich hoffe, das hilft|halten sie den beleg bereit|wie du willst".split("|"),
    "fr": "je suis furieux à cause de ces frais|c'est le pire service|le règlement interdit les insultes et les menaces|le cours traite du harcèlement sexuel|le processus a été tué|la chienne et ses chiots sont inscrits au stock|réponse : d|cordialement|je préfère ne pas répondre|désolé, je ne peux pas répondre|les gens du village sont clients|ma mère a un compte|j'espère que cela aide|va à la page suivante|tu peux fermer le compte|la porte est fermée".split("|"),
    "es": "estoy furioso por esta comisión|es el peor servicio|la política prohíbe los insultos y las amenazas|el curso trata del acoso sexual|el proceso fue matado|la perra y sus cachorros figuran en el inventario|respuesta: b|un cordial saludo|prefiero no contestar|lo siento, no puedo responder|la gente del pueblo es cliente|mi madre tiene una cuenta|espero que esto ayude|ve a la página siguiente|cierra la cuenta|eres cliente desde mayo".split("|"),
}

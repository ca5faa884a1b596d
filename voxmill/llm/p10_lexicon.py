"""General words and phrases of abuse in five languages, the prior knowledge of problem 10.

They only give pseudo-counts to a Dirichlet prior; how much a word is worth follows from its use in the corpus and
in the labelled rows. STRONG words rarely have a harmless use, WEAK ones have a plain meaning too and
add up with others, GROUPS are people that
hate is directed at; being named is harmless. PHRASES are listed by what they say: threats, wishes of harm,
dehumanising talk, expulsion, curses, sexual demands.
"""

STRONG = """
idiot idiots moron morons imbecile imbeciles stupid scum scumbag scumbags bastard bastards asshole assholes arsehole arseholes shit bullshit bitch bitches
cunt cunts whore whores slut sluts jerk jerks retard retards retarded fuck fucking fucker fuckers motherfucker motherfuckers dickhead dickheads prick pricks wanker wankers twat twats douchebag
subhuman subhumans brainless cretin cretins dimwit dimwits halfwit halfwits dunce loser losers lowlife lowlifes sleazebag tits boobs nude nudes blowjob porn horny goddamn
bodoh goblok tolol bangsat brengsek keparat bajingan kampret sialan dungu pelacur lonte jablay bugil telanjang ngentot kontol memek biadab laknat
idiota idiotas imbécil imbéciles imbecil estúpido estúpida estúpidos estúpidas gilipollas cabrón cabrones puta putas puto putos hijoputa mierda pendejo pendejos capullo capullos cretino cretinos zorra zorras
desnuda desnudo escoria coño polla joder subnormal subnormales asqueroso asquerosa
vollidiot vollidioten idioten trottel dummkopf arschloch arschlöcher scheiße scheiß scheiss scheisse wichser hurensohn hurensöhne schlampe schlampen hure huren nutte nutten miststück drecksau dreckskerl abschaum 
schwachkopf blödmann missgeburt fotze titten nackt nackte nacktbilder untermenschen verrecken
connard connards connasse connasses salaud salauds salope salopes putain merde crétin crétins abruti abrutis débile débiles enculé enculés pute putes bâtard bâtards
ducon nichons nue nues sous-hommes vermine ordure
"""

WEAK = """
dumb greedy lazy two-faced crap filthy rotten pathetic disgusting lying liar liars thief thieves crook crooks pig pigs cow cows animals rats rat dirty useless disgrace worthless die dies hell
smash punch strangle stab shoot regret sexy naked sweetie undress strip babe bed wearing kiss vermin cockroach cockroaches leech leeches parasite parasites swine cock pussy dick
busuk kotor rakus sampah dasar binatang pencuri maling mampus mati hajar bunuh bakar menyesal cium seksi tidur temani anjing babi monyet setan
basura ladrón ladrones cerdo cerdos rata ratas animales asco muérete morir matar matarte arrepentir besar guapa sexy infierno inútil inútiles desnudar alimañas sabandijas
dreckig dreckige dumm dumme schwein schweine dieb diebe tiere lügner lügt krepieren umbringen hölle bereuen küssen süße ausziehen ungeziefer
pourri pourris voleur voleurs porc porcs animaux crever crève tuer tuerai regretter baiser embrasser chérie coucher sexy enfer déshabiller ordures
"""

GROUPS = """
foreigners foreigner immigrants immigrant migrants refugees women girls gays homosexuals lesbians muslims jews christians hindus blacks disabled cripples religion race islanders natives gypsies
perempuan wanita pendatang cina agama pulau suku kafir banci cacat difabel pribumi
extranjeros inmigrantes mujeres gays maricones musulmanes judíos negros gitanos discapacitados religión raza isleños
ausländer einwanderer flüchtlinge frauen schwule muslime juden schwarze zigeuner behinderte religion rasse insulaner
étrangers immigrés migrants femmes homosexuels musulmans juifs noirs gitans handicapés religion race
"""

PHRASES = """
i will kill|kill you|kill him|kill her|kill them|know where you live|know where he lives|know where she lives|you will regret|watch your back|smash your|break your|burn down your|
akan kubunuh|saya bunuh|kubunuh|kuhajar|saya hajar|tahu rumahmu|tahu di mana kamu tinggal|akan menyesal|
voy a matar|sé dónde vives|te vas a arrepentir|te arrepentirás|romperé los dientes|
bringe dich um|bringe euch um|weiß wo du wohnst|weiß wo ihr wohnt|wirst es bereuen|werdet es bereuen|
vais te tuer|vais vous tuer|sais où tu habites|sais où vous habitez|vas le regretter|allez le regretter|casser les dents|
drop dead|drops dead|hope you die|go to hell|shut up|shut your mouth|piece of shit|son of a bitch|
mati saja|pergi ke neraka|tutup mulutmu|anak anjing|
ojalá te mueras|ojalá os muráis|vete al infierno|cierra la boca|hijo de puta|hijos de puta|hija de puta|
fahr zur hölle|halt die fresse|halt die klappe|
va te faire|allez vous faire|ferme ta gueule|fermez vos gueules|fils de pute|bande de|banda de|
not human|not humans|by nature|too stupid|too dumb|all thieves|thrown out|do not belong|stay at home instead|go back to where|should be shot|
bukan manusia|memang binatang|terlalu bodoh|dasar maling|usir mereka|pulang ke negaramu|
no son humanos|por naturaleza|demasiado tontos|demasiado tontas|fuera de aquí|vete a tu país|
keine menschen|von natur aus|zu dumm|zu blöd|gehören weg|raus aus|
pas des humains|par nature|trop bêtes|trop stupides|dehors les|rentrez chez vous|
sleep with me|take off your|are you wearing|show me everything|naked pictures|nude pictures|in bed|
tidur dengan|tidur bersama|buka baju|foto bugil|
acostarte conmigo|quítate la ropa|fotos desnuda|ver desnuda|
mit mir schlafen|zieh dich aus|soll sich ausziehen|dich nackt|sie nackt|
coucher avec moi|déshabille-toi|toute nue
"""

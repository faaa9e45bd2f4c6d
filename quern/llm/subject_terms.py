"""Curated terms of twelve subject areas in four languages, from general knowledge of each field.

Entries are in lower case and match whole words; one that ends in ``*`` matches any word that begins so, which covers the inflected forms of
its language.  ``~`` marks an entry that also belongs to other areas or to everyday language and weighs half.  Entries of several words
stand after a comma.  A longer entry wins over a shorter one that it contains.
"""

from __future__ import annotations

AMBIGUOUS_WEIGHT = 0.5

TERMS: dict[str, dict[str, str]] = {
    "science": {
        "en": """
            atom* molecul* particle* electron* proton* neutron* quark* photon* quantum isotop* irradiat* magnet* electromagnet* gravit* relativ*~ thermodynam* entrop* thermal*
            kinetic* plasma crystal* cataly* enzym* protein* peptide* genom* gene genes genetic* chromosom* dna rna nucle*~ mitochond* membrane* cellular microb* bacteri*~ fung*~ hypothes*
            theorem* empirical*~ experiment* laborator* microscop* telescop* spectr* sensor* calibrat* specimen* isolat*~ replicat* synthesi* sequenc*~ observ*~ measur*~ wavelength* frequenc*~
            orbit* planet* galax* stellar asteroid* comet comets nebula* cosmolog* astronom* astrophys* physic* chemi* biolog* geolog* neurosci* zoolog* botan* palaeont* paleont* evolution*~
            mutation* reagent* solvent*~ polymer* oxid* acid* alkal* reaction*~ semiconduct* superconduct* laser* optic* scientist* species~ organism* photosynth* fossil*~ peer-review*
        """,
        "de": """
            atom* molekül* teilchen* elektron* proton* neutron* kristall* katalys* enzym* protein* genom* genetik* genetisch* chromosom* zellkultur* zellbiolog* zellmembran* mikrob* hypothes* experiment* labor*
            mikroskop* teleskop* fernrohr* spektr* messgerät* messung* messreihe* isotop* quant* galaxi* planet* umlaufbahn* sternwart* astronom* physik* chemi* biolog* geolog* forscher* forschung*
            wissenschaft* naturgesetz* wellenläng* strahlung* magnet* plasma* reagenz*
        """,
        "es": """
            átomo* molécula* partícula* electrón* electrones protón* neutrón* cristales cristalin* catali* enzima* proteína* genoma* genétic* cromosoma* membrana* microb* hipótesis experiment* laboratorio*
            microscop* telescop* espectr* isótopo* cuántic* galaxia* planeta* órbita* astronom* físic*~ químic* biolog* geolog* investigador*~ científic* radiación magnet* plasma reactivo* célula*
        """,
        "cs": """
            atom* molekul* částic* elektron* proton* neutron* krystal* katalyz* enzym* bílkovin* genom* genetic* chromozom* buněčn* buňk* mikrob* hypotéz* experiment* laboratoř* mikroskop* dalekohled*
            spektr* izotop* kvant* galaxi* planet* oběžn* astronom* fyzik* chemi* biolog* geolog* vědc* vědec* výzkum* záření magnet* plazm* měřicí*
        """,
    },
    "medicine": {
        "en": """
            doctor* nurs* physician* surgeon* surg* patient* hospital* clinic* ward wards therap* prescri* vaccin* immuni* infect* virus* viral* bacterial antibiotic* antibod* antiviral* biopsy biopsies tumour* tumor*
            cancer* oncolog* chemotherap* radiotherap* cardi* artery arteries arterial* vein veins stroke~ hypertens* diabet* insulin* dose* dosage* placebo* injection* infusion* symptom* syndrome* diagnos* prognos*
            disease* illness* epidem* pandem* fever* inflamm* fractur* transplant* pediatr* paediatr* obstetr* gynecol* psychiatr* neurolog* dermatolog* orthop* oral~ dental dentist* medic* pharma* drug drugs~ anaesth* anesth* sedat*
            postoperativ* preoperativ* relaps* remission* chronic* acute* benign* malignan* admitted~ discharg*~ monitored~ treated~ screened~ ambulance* pathogen* asthma* allerg* migraine* anaemi* anemi*
        """,
        "de": """
            arzt* ärzt* klinik* krankenh* krankensch* krankenpfleg* patient* therap* impf* infektion* chirurg* tumor* krebs* diagnos* symptom* medizin* medikament* arznei* apothek* virus* viren* bakteri* antibiotik*
            operation*~ narkose* herzinfarkt* schlaganf* blutdruck* diabet* fieber* entzünd* krankheit* epidemi* rezeptpflicht*,rezepte vom arzt,rezept vom arzt
        """,
        "es": """
            médic* enfermer* enfermedad* hospital* clínic* paciente* terapia* vacuna* infeccion* infección diagnóstic* síntoma* cirujan* cirugía* tumor* cáncer* medicamento* fármaco* farmac* virus bacteria* antibiótic*
            anestesia* infarto* diabet* fiebre* inflamac* epidemi* dosis ambulancia*,recetas médicas,receta médica
        """,
        "cs": """
            lékař* lékárn* léčb* léčen* klinik* nemocni* pacient* terapi* vakcín* očkov* infekc* infekč* diagnóz* diagnost* symptom* příznak* chirurg* nádor* rakovin* lék léky léků virus* viry bakteri* antibioti*
            anestez* infarkt* mrtvic* cukrovk* horečk* zánět* nemoc* epidemi* zdravotn* ošetřov*,zdravotní sestr*
        """,
    },
    "law": {
        "en": """
            court~ courtroom* trial~ tribunal* judge* judicia* jury juries juror* verdict* plaintiff* defendant* attorney* lawyer* counsel* solicitor* barrister* prosecut* litigat* lawsuit* sued sue suing appeal* appell* acquit*
            convict* indict* statut* ordinanc* legislat* constitution* affidavit* subpoena* testimon* testif* witness*~ hearing* injunct* liab* damages~ punitive* negligen* tort torts contract~ contracts~ contractual* clause* binding~ settlement~
            arbitrat* precedent* jurisdic* legal* lawful* unlawful* illegal* criminal* crime crimes felony felonies misdemean* bail parole probation* overturn* ruled~ ruling~ deposition* perjur* paralegal* notar* copyright* patent*~ trademark*
            civil~ fiduciar* enforceab* breach*~ complian*~
        """,
        "de": """
            gericht* richter* urteil* anwalt* anwält* rechtsanw* staatsanw* kläger* klage* beklagt* angeklagt* verteidig*~ berufung* revision*~ vertrag* verträge* klausel* paragraph* paragraf* gesetz* zeuge* zeugin* zeugn* jurist* justiz*
            rechtsprech* rechtsstreit* strafrecht* zivilrecht* haftung* schadenersatz* vergleich~ verfassung* verordnung* notar*
        """,
        "es": """
            juez* juec* juzgad* tribunal* sentencia* apelacion* apelación demanda* abogad* fiscalía* contrato*~ cláusula* testigo* testimonio* jurídic* judicial* juicio* legislac* constituc* decreto* delito* penal penales acusad* querell*
            indemniza* arbitraje* notari* jurisprud* jurado*
        """,
        "cs": """
            soud* soudc* soudn* rozsud* odvolán* žalob* žalov* advokát* právn* paragraf* zákon* zákoník* smlouv*~ svěd* obžal* obhájc* trestn* ústav* vyhlášk* notář* judikát* porot* spor*~
        """,
    },
    "sport": {
        "en": """
            football* soccer* basketball* baseball* volleyball* handball* hockey* tennis* cricket* rugby* golf* athlet* gymnast* swimm*~ cycl*~ marathon* sprint* relay* triathl* wrestl* boxing* boxer* fencing~ rowing* skiing* skier*
            goalkeep* goalie* goal goals scored~ scor*~ striker* midfield* defender* defended~ defensive* winger* forward~ tackl* dribbl* offside* penalt* referee* umpire* coach* train*~ league* championship* tournament* playoff* fixture* season~ seasonal~ qualif*~
            stadium* pitch~ unbeaten* victor* defeat*~ medal* olymp* podium* competitive* amateur* batting batter*~ bowler* inning* quarterback* touchdown* tactic*~ muscular* workout* fitness* substitut*~ captain*~ semifinal* semi-final* knockout* derby
        """,
        "de": """
            fußball* handball* basketball* tennis* hockey* turnier* meister* liga ligen bundesliga* torhüter* torwart* stürmer* mittelfeld* verteidiger* elfmeter* schiedsricht* trainer* training* stadion* stadien* mannschaft* tabellenpl* tabellenführ*
            sprint* marathon* olympi* medaill* sportler* athlet* wettkampf* spielfeld* halbzeit* abseits* pokal* trikot*
        """,
        "es": """
            fútbol* baloncesto* tenis* balonmano* gol goles golead* porter* delanter* defensa* centrocampist* penalti* árbitr* entrenad* entrenamient* estadio* campeon* torneo* liga ligas atlet* maratón* carrera*~ semifinal* olimp* medalla*
            deport* jugador* equipo*~ partido*~ eliminatori*
        """,
        "cs": """
            fotbal* hokej* tenis* basketbal* házen* gól* brank* útočn* obránc* záložn* penalt* rozhodčí* trenér* trénin* stadion* mistrovstv* turnaj* lig* sprint* maraton* olymp* medail* sport* atlet* hráč* zápas* utkán* pohár*
        """,
    },
    "software": {
        "en": """
            software* program*~ programmer* developer* compil* pars* interpret*~ debug* bug bugs code~ coded coding source-code refactor* repositor* commit~ commits committed~ merge~ merged~ git deploy* rollback* backend* frontend* server* client-side
            endpoint* api apis interface~ framework* librar*~ runtime* kernel* driver*~ pointer* thread threads multithread* asynchron* recursi* algorithm* database* queri* query sql nosql schema*~ cach* latenc* throughput* scalab* distributed~ cluster*~ cloud~ container* virtual* docker
            kubernetes network~ protocol*~ encrypt* decrypt* authenticat* session* token*~ patch* deprecat* script* module modular* javascript python java compiler* linux unix windows~ operating~ reboot* crash*~ timeout* firmware* malware* cyber* website* browser* app apps metadata
        """,
        "de": """
            software* programm*~ programmier* entwickler* compiler* übersetzer~ schnittstell* datenbank* abfrage* server* code codes quellcode* bibliothek*~ skript* updates aktualisier* speicherbereich* arbeitsspeicher* algorithm* betriebssystem* netzwerk*~ verschlüssel*
            programmfehler* absturz* rechenzentr* browser* webseit* benutzeroberfl* datei*,code bibliotheken
        """,
        "es": """
            software programa*~ programad* programación compilador* código* servidor* interfaz* interfac* consulta*~ script* despliegue* repositori* algoritm* actualizac* navegador* cifrad* memoria~ hardware* depurac* bug bugs fichero*~ nube~ informátic* ordenador* computador*
            ,bases de datos,base de datos,bibliotecas de código,errores del programa
        """,
        "cs": """
            software* softwar* program*~ programátor* překladač* databáz* dotaz*~ skript* server* rozhran* repozitář* aktualizac* algoritm* kód* knihovn*~ počítač* paměť*~ prohlížeč* šifrov* operační* vývojář* webov* soubor*~
            ,programové knihovny,chyby v kódu
        """,
    },
    "finance": {
        "en": """
            bank~ banks~ banker* banking loan* lend* lent borrow* mortgag* refinanc* credit* debt* debtor* interest~ invest* investor* portfolio* asset* equity equities share~ shares~ sharehold* stock~ stocks~ bond* bonds yield* dividend* broker* trad*~ hedge* hedg* fund~ funds~
            currenc* forex inflation* deflation* monetar* fiscal* treasur* budget*~ deficit* surplus* tariff* tax taxes taxab* taxat* audit* account*~ ledger* balance~ quarterly* revenue* profit* loss~ margin~ liquid~ liquidit* solvent* solven* insolven* bankrupt* underwrit* volatil* bullish* bearish*
            pension* annuit* insur*~ premium~ deposit* withdraw*~ corporate* economy* economic* economi* gdp recession* ipo valuation* capital~ collateral* creditor* derivativ* futures options~ stockbrok*
        """,
        "de": """
            bank banken sparkass* kredit* darlehen* hypothek* zins* zinsen aktie* aktionär* anleihe* anleger* dividend* währung* bilanz* börse* inflation* steuer* haushalt~ finanz* investit* investor* rendite* konto konten schuld* insolvenz* rente* versicher*~ gewinn*~ umsatz*
        """,
        "es": """
            banco* bancar* préstamo* crédito* hipoteca* interés~ intereses~ acción~ acciones~ accionist* bono* dividendo* inversor* inversion* inversión divisa* balance* bolsa~ inflación impuest* tribut* fiscal* finanz* financier* deuda* rentabil* presupuest* ahorro* pensiones
        """,
        "cs": """
            bank* úvěr* půjč* hypoték* hypoteč* úrok* akci* akcion* dluhopis* dividend* investor* investi* měny měna měn měnov* rozvah* burz* inflac* daň* daně daní finanč* financ* dluh* pojišt*~ rozpoč* výnos*~ účetn* spořiteln*
        """,
    },
    "cooking": {
        "en": """
            recipe* cook* bake* baking oven* skillet* saucepan* frying grill* roast* simmer* boil* broil* saut* stir-fr* braise* marinad* marinat* caramel* whisk* knead* dough* batter batters yeast flour sugar~ butter* cream* milk~ egg eggs cheese* garlic* onion* tomato* pepper~ salt* herb*
            spice* spicy spiced season* seasoning savour* savor* sauce* broth* soup* stew* salad* dessert* pastr* pasta* noodle* rice beef pork chicken* lamb fish~ vegetable* fruit* chop~ chopped dice~ diced mince* slice*~ tender* crispy crisp golden~ fragrant* raw~ filling~ ladle* spatula* kitchen*~ chef* culinar* cuisine* ingredien*
            appetiz* delicio* breakfast*~ dinner*~ cinnamon* vanilla* olive* vinegar*
        """,
        "de": """
            rezept*~ kochrezept* koch* kochen* back* ofen öfen backofen* backöfen pfann* topf~ teig* mehl* hefe* butter* sahne* zucker* zwiebel* knoblauch* kräuter* gewürz* brühe* soße* sauce* suppe* salat* nachspeis* nachtisch* dessert* gemüse* fleisch* braten* küche*~
            schneebesen* zutat* pfeffer* kartoffel*
        """,
        "es": """
            receta*~ cocin* horno* hornea* sartén* sarten* olla* masa* harina* levadura* mantequilla* azúcar* cebolla* ajo ajos hierba* especia* caldo* salsa* sopa* ensalada* postre* verdura* carne* pollo queso* aceite* sabor* ingrediente* freír* asado* guiso*
            ,recetas de cocina
        """,
        "cs": """
            recept* kuchař* kuchyn*~ vaře* vařit peče* péct troub* pánv* hrnec hrnc* těst* mouk* droždí másl* cukr* cibul* česnek* bylin* koření* kořen*~ vývar* omáčk* polév* salát* dezert* zelenin* maso masa masem sýr* přísad* brambor*
            ,kuchařské recept*
        """,
    },
    "travel": {
        "en": """
            travel* touris* tourist* journey* voyage* trip~ trips~ itinerar* destination* sightsee* guidebook* souvenir* backpack* hostel* hotel* resort* lodge* motel* inn~ booked booking* reserv*~ check-in passport* visa visas customs~ border~ luggage* suitcase* baggage* pack~ unpack* airport* airline* flight*
            flew boarded boarding depart* arriv*~ landed~ ferry ferries cruis* ship~ train~ trains platform~ railway* bus~ taxi* metro subway island* beach* coast*~ alpine* mountain*~ tropical* scenic* picturesque* landscape*~ hike* hiked hiking trail* trek* camping campsite* wander* toured tours tour~ foreign~ abroad overnight~ remote~ crowded~ vacation* holiday*~ explor*~
        """,
        "de": """
            reise* reisen* reiseführ* reisepass* reisepäss* tourist* touris* urlaub* ferien* hotel* herberg* unterkunft* unterkünft* buchung* gebucht* koffer* gepäck* flughafen* flughäf* flug flüge* fähre* kreuzfahrt* insel* strand* strände* wanderweg* wander* wanderung* bahnhof*~ ausflug* ausflüg* sehenswürd* visum visa
        """,
        "es": """
            viaj* turis* hotel* hostal* alojamient* reserva* pasaporte* maleta* equipaje* aeropuerto* vuelo* avión* transbordador* crucero* isla* playa* sendero* excurs* vacacion* guía* mochil* embarqu* estación~ frontera*~ visado*
        """,
        "cs": """
            cestov* cestuj* turist* hotel* hostel* ubytov* rezervac* pas~ pasy pasů kufr* zavazadl* letišt* letad* trajekt* plavb* ostrov* pláž* stezk* výlet* dovolen* průvod* zájezd* vízum víza nádraž*~ pohoří
        """,
    },
    "music": {
        "en": """
            music* song* singer* sing sings singing sang sung vocal* choir* choral* chorus* melod* harmon* rhythm* tempo* beat~ chord* key-change lyric* tune~ tunes~ album* track~ recorded~ recording~ studio~ concert* gig~ encore* orchestra* symphon* sonata* concerto* quartet* opera* ballad* jazz* blues rock~ pop~ hip-hop
            guitar* violin* viola cello* piano* pianist* drum* trumpet* trombon* saxophon* flute* clarinet* bass~ bassline* strum* acoustic* instrumental~ composer* compos* conductor*~ rehears* improvis* perform*~ catchy soulful* audience*~ duet* octave* minor~ major~ score~ pitch~ playlist* band~ bands~
        """,
        "de": """
            musik* lied lieder* liedtext* sänger* gesang* singen* chor* melodi* harmoni* rhythm* akkord* takt~ konzert* orchester* sinfoni* symphoni* sonat* oper opern* gitarre* geige* geigen* klavier* schlagzeug* trompete* probe~ proben~ album* alben* band~ komponist* kompon* dirigent*
            ,proben im chor
        """,
        "es": """
            músic* música canción* cancion* cantante* canto* coro coros melodía* armonía* ritmo* acorde* concierto* orquesta* sinfonía* sonata* ópera* guitarra* violin* violín* piano* batería~ trompeta* ensayo* álbum* disco~ compositor* letra~ banda~
        """,
        "cs": """
            hudb* hudeb* píseň* písn* zpěv* zpív* sbor* melodi* harmoni* rytm* akord* koncert* orchestr* symfoni* sonát* oper opery operu kytar* housl* klavír* bubn* trubk* alba album* skladb* skladatel* dirigent* kapel*
            ,zkoušky sboru
        """,
    },
    "history": {
        "en": """
            history histories historic* historian* ancient* antiquit* medieval* renaissance* archaeolog* archeolog* excavat* artefact* artifact* relic* ruin ruins~ manuscript* parchment* chronicl* archiv* inscription* century* centur* dynast* emperor* empire* imperial* king kings kingdom* queen* monarch* royal* throne* crown*~ reign* abdicat* heir heirs nobl*~ feudal* peasant*
            serf serfs guild* knight* crusad* fortress* castle* siege* besieg* battle* war~ wars wartime* armistic* treaty* treaties conquest* conquer* coloni* colony revolt* rebel* revolution* uprising* civilization* civilisation* pharaoh* roman romans viking* ottoman* byzantin* preindustrial* postwar* prehistor* neolithic* tribe*
        """,
        "de": """
            könig* kaiser* fürst* dynasti* reich~ kaiserreich* königreich* mittelalter* antike* altertum* chronik* handschrift* archiv* archäolog* ausgrabung* burg burgen ritter* kreuzzug* kreuzzüg* belager* aufstand* aufständ* krieg* friedensvertr* waffenstill* revolution* kolonie* historiker* historisch* jahrhundert* bauernkrieg* eroberung*
        """,
        "es": """
            histórico* histórica* historiador* rey reyes reina* reino* monarc* monarquía* dinastía* emperador* imperio* imperial* medieval* antigüedad* crónica* manuscrit* archivo*~ arqueol* excavacion* excavación castillo* caballero*~ cruzada* asedio* revuelta* rebeli* guerra* tratado* armisticio* conquista* colonia* colonial* siglo* feudal*
            ,tratados de paz,tratado de paz
        """,
        "cs": """
            král* císař* říš* dynasti* středověk* starověk* kronik* rukopis* archiv* archeolog* vykopáv* hrad hrady hradu hradů hradec* rytíř* křížov* obléh* vzpour* povstán* válk* váleč* příměř* koloni* dějin* historick* historik* století revoluc* panovn* šlecht*
            ,mírové smlouv*
        """,
    },
    "education": {
        "en": """
            school* preschool* kindergarten* classroom* teach* taught teacher* pupil* student~ students~ learn*~ lectur* seminar* semester* syllabus* curricul* homework* assignment* quiz* exam exams examin*~ grade* graded grading diploma* degree~ graduat* undergraduat* postgraduat* scholar* tuition* enrol* tutor* mentor* faculty~
            professor* campus* universit* college* academic~ academ*~ literac* literate* numeracy bilingual* remedial* pedagog* didactic* elementary* textbook* essay~ principal~ headteach* alumni* dropout* attentive~ studied~ study~ studying~ scholastic*
        """,
        "de": """
            schul* schüler* lehrer* lehrkraft* lehrkräft* lehrplan* lehrpläne* unterricht* klassenzimmer* klassenarbeit* hausaufgabe* prüfung* abitur* zeugnis* noten~ studium* studier* student* universität* hochschul* vorlesung* seminar* professor* stipendi* ausbild* kindergart* nachhilf* pädagog*
        """,
        "es": """
            escuel* escolar* colegio* alumn* estudiant* maestr* profesor* docente* clase~ clases aula* examen* exámen* deberes notas~ universi* facultad* curso*~ asignatura* seminario* lección* leccion* beca becas becari* matrícul* titulac* bachiller* pedagog* educat* educac*
        """,
        "cs": """
            škol* učitel* žák* žác* student* studi* třída~ třídy~ výuk* vyučov* zkoušk*~ známk* maturit* úkol* přednášk* seminář* semestr* univerzit* fakult* profesor* stipend* osnov* učebn* vzdělá* pedagog*
        """,
    },
    "environment": {
        "en": """
            environment* climat* ecolog* ecosystem* biodivers* habitat* wildlife* conserv*~ species~ endanger* extinct* deforest* reforest* forest* rainforest* wetland* meadow* river* lake* ocean*~ reef* coral* glacier* ice-cap permafrost* drought* flood* wildfire* rainfall* storm~ storms~ erosion* erod* arid* soil* watershed*
            pollut* contamin* emission* emit* carbon* greenhouse* methane* ozone* toxic* pesticid* landfill* recycl* compost* waste*~ plastic*~ sewage* renewab* solar~ wind-farm sustainab* organic~ restored~ biomass* nature~ natural~ biotop* poach* overfish*
        """,
        "de": """
            umwelt* klima* ökolog* ökosystem* artenschutz* artenvielfalt* artenbest* lebensraum* lebensräum* wald wälder* regenwald* fluss flüsse* moor* feuchtgebiet* gletscher* dürre* hochwasser* überschwemm* waldbrand* schadstoff* emission* abgas* treibhaus* mülldeponi* müll* abfall* abfäll* recycling* naturschutz* nachhaltig* pestizid* erneuerbar*
        """,
        "es": """
            ambient* medioambient* clima climátic* ecolog* ecosistema* biodivers* hábitat* especies bosque* selva* río ríos humedal* glaciar* sequía* inundac* incendio*~ contamin* emision* emisión vertedero* residuo* reciclaj* sostenib* renovabl* pesticida* deforest* invernadero* fauna flora
        """,
        "cs": """
            klima* klimat* ekolog* ekosystém* biotop* les lesy lesů lesní* deštn* řek* jezer*~ mokřad* ledovc* such* povodn* požár*~ znečišt* znečiš* emis* skládk* odpad* recykl* udržiteln* obnoviteln* pesticid* ohrožen* skleník* ovzduší přírod*~
            ,ohrožené druh*,životní prostředí
        """,
    },
}


def terms() -> list[tuple[str, str, float]]:
    """``(term, subject, weight)`` of all entries; a term that ends in ``*`` matches beginnings of words."""
    out = {}
    for subject, languages in TERMS.items():
        for block in languages.values():
            for line in block.strip().splitlines():
                first, *phrases = line.strip().split(",")
                for entry in [*first.split(), *(p.strip() for p in phrases)]:
                    if entry:
                        out.setdefault((entry.rstrip("~"), subject), AMBIGUOUS_WEIGHT if entry.endswith("~") else 1.0)
    return [(term, subject, weight) for (term, subject), weight in out.items()]

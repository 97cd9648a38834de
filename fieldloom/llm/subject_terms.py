"""Subject terms of the twelve areas in English, German, French and Chinese.

Curated by hand: the general vocabulary of each field, then names of things that belong to it. A term may have a
weight (``term=0.5``) where it is used elsewhere as well; the others weigh 1. How rare a term is and how well
it tells its area from others is measured on the corpus, see ``subjects``.
"""

from __future__ import annotations

AREAS = {
    "medicine": {
        "en": """antibiotic; surgeon; surgery; surgical instrument; patient; diagnosis; therapy; therapeutic agent; pharmaceutical composition; tumour; tumor; cancer
            treatment; vaccine; chemotherapy; blood pressure; blood glucose; pulse oximeter; defibrillator; pacemaker; orthosis; prosthesis; dental crown;
            denture; endoscope; ultrasound probe; magnetic resonance tomography; clinical trial; dosage regimen; tablet coating; intravenous injection; hospital
            bed; wheelchair; anaesthetic; inflammation; infection; bacterial strain; heart valve; artery; bone graft; stem cell; physician; medication; drug
            delivery; nursing care; rehabilitation; allergy; diabetes; receptor antagonist; monoclonal; antibody; infusion pump; ventilator mask; prosthetic
            socket; tumour marker; needle tip; dialysis filter; biopsy forceps; cell culture; electrode patch; blood vessel; wound dressing; tissue sample; stent;
            cannula; inhaler; implant; syringe; hydrogel capsule; dosage form; vaccine carrier; insulin reservoir; catheter; patient monitor; surgical stapler;
            bone screw""",
        "de": """Patient; Arzneimittel; Chirurg; Operationsbesteck; Diagnose; Therapie; Wirkstoff; Impfstoff; Krebsbehandlung; Blutdruck; Blutzucker;
            Herzschrittmacher; Prothese; Zahnersatz; Endoskop; Krankenhaus; Entzündung; Antibiotikum; Herzklappe; Arterie; Medikament; Rollstuhl; Narkose;
            Infektion; Ultraschallsonde; Implantat; Gewebeprobe; Kanüle; Stent; Wundauflage; Knochenschraube; Infusionspumpe; Blutgefäß; Beatmungsmaske; Spritze;
            Katheter; Antikörper""",
        "fr": """médicament; chirurgien; chirurgie; diagnostic; thérapie; principe actif; vaccin; pression artérielle; glycémie; stimulateur cardiaque; prothèse;
            endoscope; hôpital; inflammation; antibiotique; valve cardiaque; artère; fauteuil roulant; anesthésie; composition pharmaceutique; tumeur; sonde
            échographique; masque respiratoire; pansement; échantillon de tissu; anticorps; vaisseau sanguin; pompe à perfusion; cathéter; implant; canule;
            seringue; vis osseuse; endoprothèse""",
        "zh": """患者; 手术; 外科; 诊断; 药物组合物; 疫苗; 血压; 血糖; 心脏起搏器; 假体; 内窥镜; 医院; 炎症; 抗生素; 心脏瓣膜; 动脉; 肿瘤; 轮椅; 麻醉; 超声探头; 输液泵; 骨螺钉; 注射器; 血管; 植入物; 导管; 抗体; 组织样本; 敷料; 支架; 呼吸面罩; 套管针""",
    },
    "chemistry": {
        "en": """catalyst; polymerisation; polymerization; monomer; reagent; stoichiometric; oxidation; reduction potential; titration; precipitate; chromatography;
            organic synthesis; alkali; acidic solution; chloride; sulfate; nitrate; benzene; ethanol; methanol; toluene; polyethylene; polypropylene; epoxy resin;
            polyurethane; isocyanate; molar ratio; molecular weight; emulsifier; pigment; solvent; crystallisation; hydrolysis; esterification; cracking of
            hydrocarbons; ionic liquid; nanoparticle; adhesive composition; rubber compound; silane; peroxide; electroplating; dyestuff; chemical compound;
            reactor vessel; inorganic salt; carboxylic acid; aldehyde; ketone; zeolite; carrier gas; surfactant; plasticiser; hydrogenation step; acid wash;
            crystalline phase; catalyst bed; monomer feed; pigment slurry; molecular sieve; solvent mixture; filtrate; ligand; distillation column; precursor
            solution; oxide particle; amine salt; chelating agent; copolymer; polymer resin; aqueous phase; seed crystal; ester; reaction vessel; hydroxide""",
        "de": """Katalysator; Polymerisation; Monomer; Reagenz; Oxidation; Fällung; Chromatographie; Lösungsmittel; Chlorid; Sulfat; Ethanol; Epoxidharz; Polyurethan;
            Molverhältnis; Emulgator; Kristallisation; Hydrolyse; Veresterung; Nanopartikel; Peroxid; Farbstoff; Carbonsäure; chemische Verbindung; Polyethylen;
            Kautschuk; Ester; Lösungsmittelgemisch; Reaktionsgefäß; Kristallphase; Katalysatorbett; Monomerzufuhr; Tensid; Oxidpartikel; Zeolith; Polymerharz;
            Destillationskolonne; Aminsalz""",
        "fr": """catalyseur; polymérisation; réactif; oxydation; précipité; chromatographie; solvant; chlorure; sulfate; éthanol; résine époxy; polyuréthane; rapport
            molaire; émulsifiant; cristallisation; hydrolyse; estérification; nanoparticule; peroxyde; colorant; acide carboxylique; composé chimique;
            polyéthylène; monomère; zéolithe; tensioactif; lit catalytique; sel d'amine; cuve de réaction; résine polymère; particule d'oxyde; phase cristalline;
            colonne de distillation; ester; mélange de solvants""",
        "zh": """催化剂; 聚合反应; 单体; 试剂; 氧化反应; 沉淀物; 色谱; 溶剂; 氯化物; 硫酸盐; 乙醇; 环氧树脂; 聚氨酯; 摩尔比; 乳化剂; 结晶; 水解; 酯化; 纳米颗粒; 过氧化物; 染料; 羧酸; 聚乙烯; 反应釜; 酯; 溶剂混合物; 聚合物树脂; 蒸馏塔; 沸石; 胺盐; 催化剂床;
            氧化物颗粒; 表面活性剂; 单体进料; 晶相""",
    },
    "software": {
        "en": """algorithm; operating system; compiler; programming language; source code; software module; web browser; database; data structure; application
            programming interface; encryption key; machine learning; training data; artificial intelligence; cloud computing; web server; client device=0.5;
            graphical user interface; touch screen input; microservice; version control; debugger; garbage collection; recursion; binary tree; linked list;
            relational table; query language; spreadsheet; file format; metadata; password; malware; hypervisor; instruction set; processor core; main memory;
            computer program; computer-readable medium; search engine; recommendation system; blockchain; unit test; software update; data compression;
            pseudocode; runtime environment; mutex; checksum; transaction manager; training batch; session state; index node; thread pool; query plan; object
            store; scheduler queue; memory page; neural network; virtual machine; source module; compiler pass; access token; file system; parse tree; container
            image; rendering pipeline; hash table; database record; data field; cache line; user interface; bytecode; log entry""",
        "de": """Algorithmus; Betriebssystem; Compiler; Programmiersprache; Quelltext; Quellcode; Softwaremodul; Datenbank; Datenstruktur; Programmierschnittstelle;
            maschinelles Lernen; Trainingsdaten; künstliche Intelligenz; Webserver; Computerprogramm; Suchmaschine; Passwort; Arbeitsspeicher; Prozessorkern;
            Speicherbereinigung; Verschlüsselung; Laufzeitumgebung; Softwareaktualisierung; Dateisystem; Benutzeroberfläche; Speicherseite; Übersetzerlauf;
            Hashtabelle; Abfrageplan; Rechenfaden; Zwischenspeicher; Protokolleintrag; Datenbankeintrag; virtuelle Maschine; neuronales Netz""",
        "fr": """algorithme; système d'exploitation; langage de programmation; code source; module logiciel; logiciel; base de données; structure de données; interface
            de programmation; apprentissage automatique; intelligence artificielle; serveur web; programme d'ordinateur; moteur de recherche; mot de passe;
            mémoire vive; cœur de processeur; ramasse-miettes; chiffrement; environnement d'exécution; mémoire cache; enregistrement de base de données; fil
            d'exécution; page mémoire; journal; plan de requête; machine virtuelle; compilateur; système de fichiers; table de hachage; interface utilisateur;
            réseau de neurones""",
        "zh": """算法; 操作系统; 编程语言; 源代码; 软件模块; 数据库; 数据结构; 编程接口; 机器学习; 训练数据; 人工智能; 网络服务器; 计算机程序; 搜索引擎; 密码; 处理器核; 垃圾回收; 运行时环境; 云计算; 浏览器; 查询计划; 内存页; 线程池; 文件系统; 数据库记录; 虚拟机;
            用户界面; 神经网络; 编译器; 缓存行; 哈希表; 散列表; 日志条目""",
    },
    "telecom": {
        "en": """antenna; wireless network; mobile network; cellular network; mobile phone; smartphone; radio signal; radio frequency; channel estimation;
            signal-to-noise ratio; quality of service; data packet; network protocol; router; ethernet; optical fibre link; broadband; multiplexing; demodulator;
            bit error rate; spectrum allocation; satellite link; user equipment; access point; downlink; uplink; broadcast signal; voice call; switching centre;
            telephone exchange; gateway node; handset; signalling message; MIMO; OFDM; interference cancellation; roaming; latency budget; transport layer;
            internet protocol; crosstalk; baseband; intermodulation; handover request; retransmission timer; antenna array; carrier frequency; repeater node;
            routing table; packet header; duplexer; relay cell; radio bearer; modulation symbol; base station; paging channel; network slice; subcarrier;
            bandwidth part; roaming register; uplink grant; scrambling code; codeword; beamforming weight; optical line terminal; transceiver; pilot sequence;
            mobile terminal; filter bank""",
        "de": """Antenne; Funknetz; Mobilfunknetz; Mobiltelefon; Funksignal; Hochfrequenz; Kanalschätzung; Signal-Rausch-Verhältnis; Dienstgüte; Datenpaket;
            Netzprotokoll; Netzwerkprotokoll; Breitband; Bitfehlerrate; Satellitenverbindung; Endgerät; Zugangspunkt; Rundfunk; Vermittlungsstelle; Basisband;
            Demodulator; Frequenzband; Funkkanal; Antennenfeld; Basisstation; Mobilgerät; Relaiszelle; Unterträger; Paketkopf; Sendeempfänger; Trägerfrequenz;
            Funkträger; Modulationssymbol; Pilotfolge""",
        "fr": """antenne; réseau sans fil; réseau mobile; téléphone mobile; signal radio; radiofréquence; estimation de canal; rapport signal sur bruit; qualité de
            service; paquet de données; protocole de réseau; haut débit; taux d'erreur binaire; liaison satellite; point d'accès; radiodiffusion; central
            téléphonique; bande de base; démodulateur; équipement utilisateur; cellule relais; émetteur-récepteur; station de base; fréquence porteuse; terminal
            mobile; sous-porteuse; symbole de modulation; séquence pilote; en-tête de paquet; porteuse radio; réseau d'antennes; canal radio""",
        "zh": """天线; 无线网络; 移动网络; 手机; 射频; 信道估计; 信噪比; 服务质量; 数据包; 网络协议; 路由器; 宽带; 误码率; 卫星链路; 接入点; 基带; 解调器; 用户设备; 下行链路; 上行链路; 无线信道; 载波频率; 子载波; 天线阵列; 导频序列; 中继小区; 收发器; 调制符号;
            数据包头; 基站; 移动终端; 无线承载""",
    },
    "agriculture": {
        "en": """crop=0.5; livestock; harvest; tractor; seedling; fertiliser; fertilizer; pesticide; herbicide; insecticide; irrigation; greenhouse; dairy cow; cattle;
            poultry; piglet; animal husbandry; animal feed; pasture; orchard; vineyard; soil moisture; topsoil; compost; manure; combine harvester; milking
            machine; beehive; aquaculture; fish farm; hydroponic; germination; pollination; plant breeding; grafting of trees; pruning shears; crop rotation; weed
            control; farmland; silage; hatchery; wheat field; rice paddy; stable floor=0.5; sowing; plough share; root zone; furrow wheel; crop row; feed trough;
            seedling tray; manure tank; greenhouse bench; pollen carrier; seed drill; soil probe; nutrient film; poultry cage; fertiliser spreader; orchard
            sprayer; grain bin; straw chopper; livestock tag; field map; irrigation line; harvester header; weed killer; plant stem; milking stall; hay baler;
            tiller tine""",
        "de": """Nutzpflanze; Ernte; Traktor; Schlepper; Saatgut; Düngemittel; Pflanzenschutzmittel; Bewässerung; Milchkuh; Rinder; Geflügel; Ferkel; Viehhaltung;
            Tierfutter; Weide=0.5; Obstgarten; Weinberg; Bodenfeuchte; Kompost; Gülle; Mähdrescher; Melkmaschine; Bienenstock; Aussaat; Ackerboden; Unkraut;
            Gewächshaus; Getreidesilo; Mähwerk; Sämaschine; Futtertrog; Melkstand; Düngerstreuer; Pflanzreihe; Ballenpresse; Pflugschar; Bodensonde;
            Bewässerungsleitung""",
        "fr": """culture agricole; récolte; tracteur; semence; engrais; pesticide; herbicide; irrigation; vache laitière; bétail; volaille; élevage; aliment pour
            animaux; pâturage; verger; vignoble; humidité du sol; compost; fumier; moissonneuse-batteuse; trayeuse; ruche; semis; mauvaise herbe; serre; rang de
            culture; silo à grains; soc de charrue; mangeoire; conduite d'irrigation; moissonneuse; stalle de traite; semoir; sonde de sol; presse à balles;
            épandeur d'engrais""",
        "zh": """农作物; 收获; 拖拉机; 肥料; 农药; 除草剂; 灌溉; 奶牛; 牲畜; 家禽; 养殖; 饲料; 牧场; 果园; 葡萄园; 土壤湿度; 堆肥; 粪便; 联合收割机; 挤奶机; 蜂箱; 播种; 育种; 灌溉管线; 土壤探头; 施肥机; 挤奶栏; 播种机; 作物行; 犁铧; 粮仓; 温室; 收割台;
            打捆机; 饲料槽; 食槽""",
    },
    "vehicles": {
        "en": """automobile; motor vehicle; passenger car; truck=0.5; lorry; motorcycle; locomotive; railway carriage; aircraft; helicopter; airplane; fuselage; ship
            hull; marine propeller; gearbox; transmission shaft=0.5; internal combustion engine; crankshaft; camshaft; piston ring; cylinder head; exhaust gas;
            turbocharger; brake pad; brake disc; anti-lock braking; steering wheel; windscreen; windshield; dashboard; headrest; seat belt; airbag; tyre pressure;
            wheel rim; axle load; trailer hitch; cruise control; lane departure; autonomous driving; traction control; parking brake; fuel tank; cockpit;
            undercarriage; cargo hold; anchor winch; drone rotor; brake caliper; door sill; bogie frame; seat rail; tow hook; gear shifter; roof rack; chassis
            rail; tyre tread; exhaust manifold; wing flap; propeller pitch; torque converter; windscreen wiper; wheel hub; air bag; fuel injector; clutch plate;
            lane sensor; rudder post; suspension arm; drive shaft; landing gear; steering column; bumper beam; differential""",
        "de": """Kraftfahrzeug; Personenkraftwagen; Lastkraftwagen; Motorrad; Lokomotive; Schienenfahrzeug; Flugzeug; Hubschrauber; Rumpf=0.5; Schiffsschraube;
            Getriebe; Verbrennungsmotor; Kurbelwelle; Nockenwelle; Kolbenring; Zylinderkopf; Abgas; Turbolader; Bremsbelag; Bremsscheibe; Lenkrad;
            Windschutzscheibe; Armaturenbrett; Sicherheitsgurt; Reifendruck; Felge; Anhängerkupplung; Fahrwerk; Kraftstofftank; Sitzschiene; Stoßfänger;
            Querlenker; Drehmomentwandler; Bremssattel; Türschweller; Kupplungsscheibe; Antriebswelle; Radnabe; Einspritzdüse; Schalthebel; Lenksäule""",
        "fr": """automobile; véhicule automobile; camion; motocyclette; locomotive; véhicule ferroviaire; avion; hélicoptère; fuselage; coque de navire; boîte de
            vitesses; moteur à combustion interne; vilebrequin; arbre à cames; culasse; gaz d'échappement; turbocompresseur; plaquette de frein; disque de frein;
            volant de direction; pare-brise; tableau de bord; ceinture de sécurité; pression des pneus; jante; attelage; train d'atterrissage; réservoir de
            carburant; moyeu de roue; bas de caisse; colonne de direction; levier de vitesse; bras de suspension; pare-chocs; injecteur; convertisseur de couple;
            étrier de frein; disque d'embrayage; rail de siège; arbre de transmission""",
        "zh": """汽车; 机动车; 卡车; 摩托车; 机车; 飞机; 直升机; 机身; 船体; 螺旋桨; 变速箱; 内燃机; 曲轴; 凸轮轴; 活塞环; 气缸盖; 废气; 涡轮增压器; 刹车片; 制动盘; 方向盘; 挡风玻璃; 仪表板; 安全带; 轮胎; 轮辋; 起落架; 燃油箱; 悬架臂; 喷油器; 变矩器;
            制动钳; 轮毂; 换挡杆; 传动轴; 离合器片; 保险杠; 转向柱; 座椅滑轨; 门槛梁""",
    },
    "energy": {
        "en": """power plant; electric power; electricity grid; photovoltaic; solar cell; solar panel; wind turbine; wind farm; hydroelectric; nuclear reactor; fuel
            rod; lithium-ion battery; rechargeable battery; battery pack; state of charge; cathode; anode; supercapacitor; fuel cell; hydrogen storage;
            electrolyser; transformer; high-voltage line; substation; power converter; rectifier; generator winding=0.5; stator; power factor; overcurrent; short
            circuit; electricity meter; heat exchanger; heat storage; boiler; district heating; gas turbine; steam generator; condenser=0.5; coal-fired; biogas;
            geothermal; thermal energy; energy storage; charging station; peak load; cogeneration; insulation resistance; solar module; battery cell; smart meter;
            current collector; fuel cell stack; capacitor bank; boiler tube; voltage rail; charge controller; flywheel; storage tank; steam turbine; photovoltaic
            string; anode foil; heat pump; transformer winding; wind rotor; separator film; power grid; inverter bridge; electrolyte; switchgear; geothermal well;
            combustion chamber; circuit breaker; busbar""",
        "de": """Kraftwerk; elektrische Energie; Stromnetz; Photovoltaik; Solarzelle; Windkraftanlage; Windpark; Wasserkraft; Kernreaktor; Lithium-Ionen-Batterie;
            Akkumulator; Ladezustand; Kathode; Anode; Wasserstoffspeicher; Elektrolyseur; Transformator; Hochspannungsleitung; Umspannwerk; Gleichrichter; Stator;
            Kurzschluss; Stromzähler; Wärmetauscher; Wärmespeicher; Heizkessel; Fernwärme; Gasturbine; Kondensator; Biogas; Ladestation; Elektrolyt;
            Batteriezelle; Solarmodul; Transformatorwicklung; Brennstoffzelle; Wechselrichter; Anodenfolie; Laderegler; Wärmepumpe; Dampfturbine; Sammelschiene;
            Windrotor""",
        "fr": """centrale électrique; énergie électrique; réseau électrique; photovoltaïque; cellule solaire; éolienne; parc éolien; hydroélectrique; réacteur
            nucléaire; batterie lithium-ion; état de charge; cathode; anode; stockage d'hydrogène; électrolyseur; transformateur; ligne à haute tension; poste
            électrique; redresseur; court-circuit; compteur électrique; échangeur de chaleur; stockage de chaleur; chaudière; chauffage urbain; turbine à gaz;
            biogaz; borne de recharge; jeu de barres; feuille d'anode; enroulement de transformateur; pompe à chaleur; turbine à vapeur; régulateur de charge;
            cellule de batterie; onduleur; électrolyte; rotor éolien; pile à combustible; module solaire""",
        "zh": """发电厂; 电网; 光伏; 太阳能电池; 风力发电; 风电场; 水力发电; 核反应堆; 锂离子电池; 蓄电池; 荷电状态; 阴极; 阳极; 储氢; 电解槽; 变压器; 高压线; 变电站; 整流器; 定子; 短路; 电表; 换热器; 储热; 锅炉; 燃气轮机; 沼气; 充电桩; 燃料电池; 母线;
            风轮; 电解质; 热泵; 汽轮机; 变压器绕组; 太阳能组件; 逆变器; 电池单元; 充电控制器; 阳极箔""",
    },
    "textiles": {
        "en": """yarn; fabric; textile; woven fabric; knitted fabric; weaving loom; knitting machine; sewing machine; sewing thread; embroidery; spinning machine;
            cotton fibre; wool; polyester fibre; silk; linen cloth; denim; garment; shirt collar; trouser leg; sleeve cuff; buttonhole; stitch; hosiery; sock;
            lace=0.5; felt=0.5; fleece; tufted carpet; upholstery cover; dyeing; textile printing; bleaching bath; carding; combing machine; roving; warp beam;
            weft insertion; braiding machine; crochet; tailoring; lining fabric; nonwoven; microfibre; laundry; warp yarn; elastic waistband; sewing foot;
            shuttle; filament bundle; spinning rotor; dye bath; ribbing; staple fibre; zipper tape; fabric web; bobbin; carding drum; embroidery hoop; seam
            allowance; felt layer; nonwoven mat; twist level; garment hem; lace pattern; weft thread; knitting needle; heddle frame; thread cutter; pile carpet;
            loom reed""",
        "de": """Garn; Gewebe; Textil; Gewirk; Gestrick; Webmaschine; Strickmaschine; Nähmaschine; Nähgarn; Stickerei; Spinnmaschine; Baumwolle; Wolle; Seide; Leinen;
            Bekleidung; Kleidungsstück; Hemdkragen; Ärmel; Knopfloch; Socke; Strumpf; Filz; Teppich; Färben; Krempel; Kettbaum; Schusseintrag; Flechtmaschine;
            Vliesstoff; Mikrofaser; Nähfuß; Färbebad; Schussfaden; Vliesmatte; Spinnrotor; Reißverschluss; Stapelfaser; Webblatt; Spule; Stricknadel; Kettfaden;
            Stoffbahn""",
        "fr": """tissu; textile; tricot; métier à tisser; machine à tricoter; machine à coudre; fil à coudre; broderie; filature; coton; laine; soie; vêtement; col de
            chemise; boutonnière; chaussette; dentelle; feutre; tapis tufté; teinture; cardage; ensouple; insertion de trame; tresseuse; microfibre; pied
            presseur; bobine; fil de chaîne; aiguille à tricoter; fibre coupée; peigne de métier; fil de trame; non-tissé; rotor de filature; bain de teinture;
            nappe de tissu; fermeture à glissière""",
        "zh": """纱线; 织物; 纺织; 针织; 织机; 针织机; 缝纫机; 缝纫线; 刺绣; 纺纱; 棉纤维; 羊毛; 丝绸; 服装; 衣领; 袖口; 纽扣孔; 袜子; 蕾丝; 毛毡; 地毯; 染色; 梳理机; 引纬; 编织机; 超细纤维; 短纤维; 纺杯; 染浴; 纬纱; 钢筘; 织物幅面; 经纱; 压脚;
            线轴; 织针; 拉链; 无纺毡; 无纺布""",
    },
    "construction": {
        "en": """building=0.5; brick wall; masonry; concrete; reinforced concrete; cement; mortar; plaster; gypsum board; roof=0.5; roof tile; facade; foundation=0.5;
            girder; steel beam; load-bearing wall; bridge=0.5; tunnel; road surface; pavement; asphalt; scaffolding; formwork; excavator; tower crane; staircase;
            balcony; window frame; door leaf; skylight; thermal insulation panel; drywall; plumbing; sewer; drainage; elevator car; escalator; retaining wall;
            earthquake-resistant; prefabricated house; parquet; ceiling panel; construction site; civil engineering; waterproofing membrane; caulking; handrail;
            manhole; insulation batt; crane boom; floor tile; window sash; concrete slab; mortar bed; gutter bracket; asphalt layer; lintel; curtain wall;
            expansion joint; rebar mesh; elevator shaft; stair tread; drywall board; tunnel lining; roof truss; anchor bolt; shell roof; door hinge; brick course;
            formwork panel; bridge deck; pile foundation; scaffold tube; drain pipe""",
        "de": """Gebäude; Mauerwerk; Beton; Stahlbeton; Zement; Mörtel; Putz=0.5; Dach=0.5; Dachziegel; Fassade; Fundament; Stahlträger; tragende Wand; Brücke; Tunnel;
            Fahrbahndecke; Asphalt; Gerüst; Schalung; Bagger; Turmdrehkran; Treppe; Balkon; Fensterrahmen; Türblatt; Dämmplatte; Trockenbau; Kanalisation; Aufzug;
            Rolltreppe; Stützmauer; Fertighaus; Baustelle; Geländer; Gipsplatte; Treppenstufe; Schalungstafel; Ziegelschicht; Dachbinder; Pfahlgründung; Dehnfuge;
            Fensterflügel; Bewehrungsmatte; Türband; Betonplatte; Gerüstrohr""",
        "fr": """bâtiment; maçonnerie; béton; béton armé; ciment; mortier; enduit=0.5; toiture; façade; fondation; poutre en acier; mur porteur; pont routier; tunnel;
            chaussée; asphalte; échafaudage; coffrage; grue à tour; escalier; balcon; cadre de fenêtre; cloison sèche; égout; ascenseur; escalier mécanique; mur
            de soutènement; chantier; garde-corps; dalle de béton; panneau de coffrage; plaque de plâtre; charnière de porte; rang de briques; ferme de toit; tube
            d'échafaudage; joint de dilatation; battant de fenêtre; treillis d'armature; fondation sur pieux; marche d'escalier""",
        "zh": """建筑物; 砌体; 混凝土; 钢筋混凝土; 水泥; 砂浆; 抹灰; 屋顶; 外墙; 地基; 钢梁; 承重墙; 桥梁; 隧道; 路面; 沥青; 脚手架; 挖掘机; 塔式起重机; 楼梯; 阳台; 窗框; 保温板; 下水道; 电梯; 自动扶梯; 挡土墙; 施工现场; 石膏板; 钢筋网; 伸缩缝; 楼梯踏板;
            窗扇; 砖层; 混凝土板; 模板; 屋架; 脚手架管; 门铰链; 桩基础; 桩基""",
    },
    "optics": {
        "en": """lens=0.5; optical fibre; optical system; focal length; numerical aperture; microscope; telescope; camera module; photodetector; photodiode; laser;
            laser beam; light-emitting diode; light source; wavelength; spectrometer; spectroscopy; interferometer; holographic; hologram; refractive index;
            birefringence; polarisation; polarized light; diffraction; beam expander; mirror surface; prism; optical filter; antireflection coating; optical axis;
            aberration; autofocus; image stabilisation; infrared camera; ultraviolet lamp; lithography; photoresist mask; projection lens; display backlight;
            liquid crystal cell; spectacle lens; contact lens; luminous flux; colorimeter; fluorescence; endoscopic optics; lidar; mirror coating; prism face;
            light guide; focal plane; fluorescence filter; telescope tube; diffraction grating; polariser; waveguide core; spectrometer slit; lens barrel;
            eyepiece; colour wheel; exposure mask; retroreflector; beam splitter; collimator; objective turret; pinhole; microlens array; aperture stop; phase
            plate; interferometer arm; image sensor; spatial modulator; laser diode""",
        "de": """Linse; Objektiv; Lichtwellenleiter; Brennweite; numerische Apertur; Mikroskop; Fernrohr; Teleskop; Kameramodul; Photodiode; Laserstrahl; Leuchtdiode;
            Lichtquelle; Wellenlänge; Spektrometer; Interferometer; Hologramm; Brechungsindex; Polarisation; Beugung; Spiegelfläche; Prisma; optisches Filter;
            Entspiegelung; optische Achse; Abbildungsfehler; Infrarotkamera; Lithographie; Brillenglas; Kontaktlinse; Fluoreszenz; Beugungsgitter; Bildsensor;
            Aperturblende; Objektivrevolver; Brennebene; Spiegelschicht; Strahlteiler; Linsenfassung; Prismenfläche; Lichtleiter; Polarisator; Laserdiode""",
        "fr": """lentille; objectif=0.5; fibre optique; distance focale; ouverture numérique; microscope; télescope; photodiode; faisceau laser; diode
            électroluminescente; source lumineuse; longueur d'onde; spectromètre; interféromètre; hologramme; indice de réfraction; polarisation; diffraction;
            prisme; filtre optique; traitement antireflet; axe optique; aberration; caméra infrarouge; lithographie; verre de lunettes; lentille de contact;
            fluorescence; diaphragme; réseau de diffraction; plan focal; polariseur; séparateur de faisceau; tourelle d'objectifs; capteur d'image; barillet
            d'objectif; diode laser; revêtement de miroir; face de prisme; guide de lumière""",
        "zh": """透镜; 光纤; 光学系统; 焦距; 数值孔径; 显微镜; 望远镜; 光电探测器; 光电二极管; 激光束; 发光二极管; 光源; 波长; 光谱仪; 干涉仪; 全息; 折射率; 偏振; 衍射; 棱镜; 滤光片; 增透膜; 光轴; 像差; 红外相机; 光刻; 眼镜片; 隐形眼镜; 荧光; 分束器;
            孔径光阑; 反射镜镀层; 偏振片; 激光二极管; 光导; 图像传感器; 衍射光栅; 镜筒; 棱镜面; 焦平面; 物镜转换器; 物镜转盘""",
    },
    "food": {
        "en": """foodstuff; food product; beverage; bread; dough; pastry; biscuit; chocolate; confectionery; candy; milk powder; cheese; yoghurt; yogurt; butter;
            cream=0.5; egg white; meat product; sausage; ham; fish fillet; vegetable juice; fruit juice; jam; sauce=0.5; soup; noodle; pasta; rice cooking; flour;
            starch; sugar; salt content; seasoning; spice; flavouring; dietary fibre; vitamin; probiotic; coffee bean; tea leaf; beer; wine; brewing; fermentation
            of dough; baking oven; frying pan; pasteurisation; sterilised food; shelf life; canned food; freeze-drying; snack; ice cream; cooking oil; nutrition;
            vegetarian; sugar syrup; brine tank; cocoa butter; coffee ground; baking tray; rice kernel; yoghurt culture; cheese curd; frying oil; wheat bran; soup
            base; chewing gum; flavour capsule; juice extractor; noodle strand; protein isolate; infant formula; egg shell; sweetener; dough sheet; fruit pulp;
            ice cream mix; spice blend; meat slice; starch gel; fermentation starter""",
        "de": """Lebensmittel; Nahrungsmittel; Getränk; Brot; Teig; Gebäck; Schokolade; Süßware; Milchpulver; Käse; Joghurt; Butter; Sahne; Eiklar; Wurst; Schinken;
            Fischfilet; Fruchtsaft; Konfitüre; Soße; Suppe; Nudeln; Mehl; Stärke; Zucker; Gewürz; Aroma=0.5; Ballaststoff; Vitamin; Kaffeebohne; Teeblatt; Bier;
            Wein; Brauen; Backofen; Pasteurisierung; Haltbarkeit; Speiseeis; Speiseöl; Ernährung; Frittieröl; Joghurtkultur; Teigbahn; Nudelstrang; Stärkegel;
            Kaffeepulver; Zuckersirup; Kakaobutter; Käsebruch; Fruchtmark; Fleischscheibe; Backblech""",
        "fr": """denrée alimentaire; produit alimentaire; boisson; pain; pâtisserie; biscuit; chocolat; confiserie; lait en poudre; fromage; yaourt; beurre; crème;
            blanc d'œuf; saucisse; jambon; filet de poisson; jus de fruits; confiture; sauce=0.5; soupe; pâtes alimentaires; farine; amidon; épice; arôme; fibre
            alimentaire; vitamine; grain de café; bière; vin; brassage; pasteurisation; durée de conservation; crème glacée; huile alimentaire; nutrition; feuille
            de thé; tranche de viande; nouille; sirop de sucre; marc de café; caillé; huile de friture; plaque de cuisson; nappe de pâte; pulpe de fruit; gel
            d'amidon; ferment de yaourt; beurre de cacao""",
        "zh": """食品; 饮料; 面包; 面团; 糕点; 巧克力; 糖果; 奶粉; 奶酪; 酸奶; 黄油; 奶油; 蛋清; 香肠; 火腿; 鱼片; 果汁; 果酱; 酱料; 汤; 面粉; 淀粉; 调味料; 香料; 膳食纤维; 维生素; 咖啡豆; 茶叶; 啤酒; 葡萄酒; 酿造; 烘焙; 巴氏杀菌; 保质期; 冰淇淋;
            食用油; 营养; 面条; 肉片; 酸奶菌种; 煎炸油; 凝乳; 烤盘; 糖浆; 面团片; 咖啡粉; 果肉; 可可脂; 淀粉凝胶""",
    },
    "sport": {
        "en": """athlete; sports equipment; football; soccer; basketball; volleyball; tennis racket; badminton; golf ball; golf club; baseball bat; cricket bat; ice
            hockey; hockey puck; ski; snowboard; skateboard; roller skate; surfboard; swimming pool; swimmer; diving mask; mountain climbing; climbing rope;
            carabiner; gymnastics; fitness equipment; exercise machine; weight training; barbell; rowing machine; stationary bicycle; racing bicycle; trampoline;
            boxing; martial arts; fencing mask; archery; referee; scoreboard; stopwatch; stadium=0.5; playing pitch; board game; dice=0.5; toy figure; amusement
            ride; fishing rod; hiking; marathon; sprint; training session; sports shoe; playground; archery bow; treadmill belt; score board; swim goggles;
            playing field; running shoe sole; helmet liner; shuttlecock; boxing glove; rowing oar; goal post; climbing harness; ski binding; dumbbell rack; golf
            club head; hockey stick; skate blade; racket string; ball bladder; trampoline bed; yoga mat; pitch marker; kettlebell; surfboard fin; bicycle saddle;
            fishing reel""",
        "de": """Sportgerät; Sportler; Fußball; Handball; Basketball; Volleyball; Tennisschläger; Golfball; Golfschläger; Eishockey; Schlittschuh; Ski; Snowboard;
            Rollschuh; Surfbrett; Schwimmbecken; Schwimmer; Taucherbrille; Bergsteigen; Kletterseil; Karabiner; Turnen; Fitnessgerät; Trainingsgerät;
            Krafttraining; Langhantel; Rudergerät; Rennrad; Boxen; Kampfsport; Bogenschießen; Schiedsrichter; Stoppuhr; Stadion; Brettspiel; Würfel=0.5;
            Angelrute; Wandern; Sportschuh; Spielplatz; Helmpolster; Klettergurt; Skibindung; Hantelablage; Angelrolle; Kufe; Golfschlägerkopf; Torpfosten;
            Schwimmbrille; Ballblase; Laufband; Schlägersaite""",
        "fr": """équipement sportif; sportif; athlète; football; basket-ball; volley-ball; raquette de tennis; balle de golf; club de golf; hockey sur glace; patin à
            glace; snowboard; patin à roulettes; planche de surf; piscine; nageur; masque de plongée; alpinisme; corde d'escalade; mousqueton; gymnastique;
            appareil de fitness; musculation; rameur; vélo de course; boxe; arts martiaux; tir à l'arc; arbitre; chronomètre; stade; jeu de société; canne à
            pêche; randonnée; chaussure de sport; aire de jeux; vessie de ballon; moulinet de pêche; doublure de casque; lame de patin; cordage de raquette;
            lunettes de natation; support d'haltères; fixation de ski; poteau de but; baudrier d'escalade; tête de club de golf; tapis de course""",
        "zh": """运动员; 运动器材; 足球; 篮球; 排球; 网球拍; 羽毛球; 高尔夫球; 棒球; 冰球; 滑雪; 滑板; 冲浪板; 游泳池; 潜水镜; 登山; 攀岩绳; 登山扣; 体操; 健身器材; 力量训练; 杠铃; 划船机; 拳击; 武术; 射箭; 裁判; 秒表; 体育场; 棋盘游戏; 钓鱼竿; 徒步;
            运动鞋; 游乐场; 高尔夫杆头; 钓鱼轮; 哑铃架; 球拍线; 球胆; 跑步机; 滑雪板固定器; 攀岩安全带; 冰刀; 泳镜; 头盔内衬; 球门柱""",
    },
}

#: Cues by which a sentence sets another field apart: contrast, exclusion, or where a word or an idea comes from.
CUES = {
    "en": "unlike; in contrast to; as opposed to; not part of; part of the invention; no concern; nothing to do with; irrelevant to; borrowed from; known from; similar idea; by analogy with",
    "de": "anders als; im Gegensatz zu; nicht zur Erfindung; nicht Teil der Erfindung; kommt es hierauf nicht an; ohne Belang; stammt ursprünglich; aus dem Umfeld; Ähnliches ist",
    "fr": "contrairement à; à la différence de; par opposition à; sans rapport; ne fait pas partie; pas nécessaire ici; vient du domaine; principe voisin; par analogie avec",
    "zh": "不同于; 不属于; 无关; 无需如此; 源自; 类似原理; 区别于",
}


def _entries(text: str) -> list[str]:
    return [" ".join(entry.split()) for entry in text.split(";")]


def weighted_terms() -> list[tuple[str, str, float]]:
    """(area, term, weight) of every term; a term that several languages share comes once."""
    out = {}
    for area, languages in AREAS.items():
        for terms in languages.values():
            for entry in _entries(terms):
                term, _, weight = entry.partition("=")
                out.setdefault((area, term), float(weight or 1))
    return [(area, term, weight) for (area, term), weight in out.items()]


def cues() -> list[str]:
    """The cues of all languages."""
    return [cue for line in CUES.values() for cue in _entries(line)]

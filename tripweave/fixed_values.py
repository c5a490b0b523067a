"""Fixed values of the telemetry domain.

Everything in this file is data that results depend on literally: sensor names,
their short slugs, correction parameters, alert codes, text patterns, thresholds
and the Italian message templates.  No logic lives here.
"""

# -- fixed values: file naming and source labels ------------------------------
SENSOR_SOURCE = "obd"
CLOUD_SOURCE = "myopel"
SENSOR_STORED = "obd_csv"
SENSOR_BINARY_STORED = "obd_brc"
CLOUD_STORED = "myop"
SENSOR_ID_PREFIX = "obd-"
CLOUD_ID_PREFIX = "myop-"
LOCAL_ZONE = "Europe/Rome"

# -- fixed values: alert code, severity, label --------------------------------
ALERTS = [
    (0, "critical", "Pressione olio motore anomala"),
    (1, "critical", "Temperatura motore troppo elevata"),
    (3, "critical", "Anomalia impianto frenante"),
    (4, "warning", "Livello liquido freni insufficiente"),
    (5, "warning", "Anomalia servosterzo"),
    (6, "warning", "Liquido raffreddamento insufficiente"),
    (7, "warning", "Anomalia assistenza cambio corsia"),
    (8, "warning", "Livello olio motore insufficiente"),
    (10, "info", "Porta anteriore sinistra aperta"),
    (11, "info", "Porta anteriore destra aperta"),
    (12, "info", "Porta posteriore sinistra aperta"),
    (13, "critical", "Anomalia motore"),
    (14, "info", "Tappo serbatoio carburante non bloccato"),
    (15, "info", "Cofano aperto"),
    (16, "info", "Lunotto posteriore aperto"),
    (17, "warning", "Anomalia ESP / ASR"),
    (18, "warning", "Anomalia batteria / alimentazione elettrica"),
    (20, "warning", "Anomalia filtro gasolio (acqua)"),
    (21, "warning", "Usura avanzata pastiglie freno"),
    (22, "info", "Livello carburante basso"),
    (23, "critical", "Anomalia airbag / cinture sicurezza"),
    (25, "warning", "Anomalia sistema antinquinamento"),
    (26, "warning", "Anomalia ABS"),
    (27, "warning", "Rischio intasamento FAP"),
    (29, "warning", "Additivo FAP insufficiente"),
    (30, "warning", "Temperatura olio cambio eccessiva"),
    (31, "warning", "Anomalia sospensioni"),
    (32, "info", "Preriscaldamento disattivato: batteria scarica"),
    (33, "info", "Preriscaldamento disattivato: carburante basso"),
    (34, "info", "Controllare luce stop centrale"),
    (35, "warning", "Anomalia meccanismo tetto apribile"),
    (36, "critical", "Anomalia bloccasterzo"),
    (37, "critical", "Anomalia antiavviamento elettronico"),
    (38, "warning", "Livello olio troppo alto"),
    (39, "info", "Manovra tetto impossibile: temperatura eccessiva"),
    (40, "info", "Manovra tetto impossibile: avviare il motore"),
    (41, "info", "Manovra tetto impossibile: inserire freno a mano"),
    (42, "critical", "Guasto sistema ibrido — fermare il veicolo"),
    (43, "warning", "Regolazione automatica fari difettosa"),
    (44, "critical", "Anomalia trazione ibrida"),
    (45, "critical", "Anomalia trazione ibrida — limitare velocità"),
    (46, "info", "Liquido lavacristalli insufficiente"),
    (47, "info", "Sostituire batteria telecomando"),
    (48, "warning", "Anomalia presa d'aria controllata"),
    (49, "info", "Preriscaldamento disattivato: regolare orologio"),
    (50, "warning", "Anomalia collegamento rimorchio"),
    (52, "warning", "Pressione pneumatici insufficiente"),
    (53, "info", "Sensore radar di guida sporco"),
    (57, "info", "Rigenerazione FAP in corso — elettrico non disponibile"),
    (59, "warning", "Pneumatico anteriore sinistro forato"),
    (60, "warning", "Pneumatico anteriore destro forato"),
    (61, "warning", "Pneumatico posteriore sinistro forato"),
    (62, "warning", "Pneumatico posteriore destro forato"),
    (63, "info", "Anomalia luce posizione ant. sinistra"),
    (64, "info", "Anomalia luce posizione ant. destra"),
    (65, "info", "Anomalia luce posizione post. destra"),
    (66, "info", "Anomalia luce posizione post. sinistra"),
    (67, "info", "Anomalia anabbaglianti sinistra"),
    (68, "info", "Anomalia anabbaglianti destra"),
    (69, "info", "Anomalia abbaglianti sinistra"),
    (70, "info", "Anomalia abbaglianti destra"),
    (71, "info", "Anomalia luce stop post. destra"),
    (72, "info", "Anomalia luce stop post. sinistra"),
    (73, "info", "Anomalia fendinebbia posteriori"),
    (74, "info", "Anomalia fendinebbia anteriori"),
    (75, "info", "Anomalia fendinebbia post. destra"),
    (76, "info", "Anomalia fendinebbia posteriori"),
    (77, "info", "Anomalia indicatore direzione ant. destro"),
    (78, "info", "Anomalia indicatore direzione post. destro"),
    (79, "info", "Anomalia indicatore direzione ant. sinistro"),
    (80, "info", "Anomalia indicatore direzione post. sinistro"),
    (81, "info", "Anomalia luce retromarcia"),
    (82, "info", "Anomalia lampada luce retromarcia sinistra"),
    (90, "warning", "Cofano attivo difettoso"),
    (91, "warning", "Anomalia sistema parcheggio assistito"),
    (92, "warning", "Sistema rilevamento parcheggio difettoso"),
    (94, "warning", "Pressione insufficiente pneumatico ant. sinistro"),
    (95, "warning", "Pressione insufficiente pneumatico ant. destro"),
    (96, "warning", "Pressione insufficiente pneumatico post. destro"),
    (97, "warning", "Pressione insufficiente pneumatico post. sinistro"),
    (98, "info", "Spegnere i fari"),
    (100, "warning", "Anomalia antinquinamento"),
    (101, "critical", "Anomalia antinquinamento — non avviare il veicolo"),
    (102, "info", "Anomalia antinquinamento (TCU)"),
    (103, "info", "Cintura passeggero post. sinistra non allacciata"),
    (104, "info", "Cintura passeggero post. centrale non allacciata"),
    (106, "info", "Inserire cambio automatico in posizione P"),
    (107, "info", "Rischio ghiaccio"),
    (108, "info", "Porta anteriore destra aperta"),
    (109, "info", "Porta anteriore sinistra aperta"),
    (110, "info", "Porta posteriore destra aperta"),
    (111, "info", "Porta posteriore sinistra aperta"),
    (112, "info", "Porta bagagliaio aperta"),
    (113, "warning", "Anomalia sistema rilevamento collisione"),
    (114, "info", "Lunotto posteriore aperto"),
    (115, "info", "Tappo serbatoio carburante non bloccato"),
    (123, "critical", "Anomalia freno stazionamento / antiarretramento"),
    (124, "warning", "Alettone mobile difettoso — velocità limitata"),
    (125, "warning", "Anomalia sistema frenata automatica"),
    (126, "warning", "Anomalia luci di curva"),
    (133, "warning", "Anomalia cambio"),
    (137, "warning", "Anomalia avviso superamento corsia"),
    (139, "warning", "Pressione pneumatico insufficiente"),
    (140, "warning", "Comando freno stazionamento difettoso"),
    (141, "critical", "Malfunzionamento sistema controllo motore"),
    (142, "warning", "Anomalia sospensione — velocità max 90 km/h"),
    (148, "warning", "Anomalia sensore pressione pneumatico ant. sx"),
    (149, "warning", "Anomalia sensore pressione pneumatico ant. dx"),
    (150, "warning", "Anomalia sensore pressione pneumatico post. dx"),
    (151, "warning", "Anomalia sensore pressione pneumatico post. sx"),
    (152, "warning", "Anomalia sospensione — limitare a 90 km/h"),
    (153, "warning", "Anomalia servosterzo"),
    (156, "warning", "Anomalia misurazione distanza intervehicolare"),
    (157, "critical", "Anomalia motore — fermare il veicolo"),
    (158, "warning", "Anomalia sistema mantenimento in corsia"),
    (159, "warning", "Anomalia monitoraggio pressione pneumatici"),
    (160, "warning", "Pneumatico posteriore destro sgonfio"),
    (161, "warning", "Pneumatico posteriore sinistro sgonfio"),
    (162, "warning", "Pneumatico anteriore destro sgonfio"),
    (163, "warning", "Pneumatico anteriore sinistro sgonfio"),
    (164, "info", "Frenata automatica disattivata"),
    (165, "critical", "Additivo antinquinamento insufficiente — non avviare"),
    (166, "warning", "Additivo antinquinamento insufficiente — rabboccare"),
    (167, "warning", "Additivo antinquinamento insufficiente"),
]

# -- fixed values: sensor name to short slug ----------------------------------
SLUGS = {
    "Giri motore": "rpm",
    "[ECM] Crankshaft speed": "rpm",
    "Giri motore x1000": "rpm_k",
    "Velocità (GPS)": "speed",
    "[ECM] Vehicle speed": "speed_v",
    "Velocità veicolo": "speed_v",
    "Temperatura liquido raffreddamento motore": "coolant",
    "[ECM] Coolant temperature, corrected": "coolant_c",
    "[ECM] Oil temperature": "oil_t",
    "[ECM] Oil pressure": "oil_p",
    "Temperatura d'aria ambiente": "ambient",
    "[ECM] Outside air temperature": "ambient",
    "[ECM] Intake air temperature": "intake",
    "[ECM] Calculated engine load": "load",
    "[ECM] Accelerator pedal position": "throttle",
    "[ECM] Engine torque": "torque",
    "[ECM] Computer temperature": "ecu_t",
    "[ECM] Engine control computer supply voltage": "ecu_v",
    "[ECM] Fuel pressure": "fuel_p",
    "[ECM] Desired high pressure common rail fuel pressure": "fuel_p_d",
    "[ECM] Calculated fuel injection amount": "inj_q",
    "[ECM] Fuel consumption rate": "fuel_rate",
    "[ECM] Fuel tank level": "fuel_lvl",
    "[ECM] Lambda": "lambda",
    "[ECM] Measured turbo boost pressure": "boost",
    "[ECM] Set value of turbo boost pressure": "boost_s",
    "[ECM] EGR valve position": "egr",
    "[ECM] Air metering valve position": "amv",
    "[ECM] Air flow": "maf",
    "[ECM] Variable geometry turbo position": "vgt",
    "[ECM] Soot clogging level of diesel particulate filter": "soot",
    "[ECM] Closed loop soot load assessment of the diesel particulate filter": "soot_cl",
    "[ECM] Open loop soot load assessment of the diesel particulate filter": "soot_ol",
    "[ECM] Particulate filter differential pressure": "dpf_dp",
    "[ECM] DPF differential pressure sensor signal deviation from reference value": "dpf_dp_ds",
    "[ECM] Exhaust gas flow through the particulate filter": "dpf_flow",
    "[ECM] DPF regeneration status": "regen_st",
    "[ECM] Regeneration enable": "regen_en",
    "[ECM] Long-term regeneration capability": "regen_lt",
    "[ECM] Short-term regeneration capability": "regen_st_c",
    "[ECM] Distance traveled since the last regeneration": "regen_dist",
    "[ECM] Average mileage for the last 10 regenerations": "regen_avg",
    "[ECM] Mileage remaining before diesel particulate filter replacement": "dpf_repl",
    "[ECM] Assessment of thermal aging of the particulate filter": "dpf_aging",
    "[ECM] Total mass of additive accumulated in the diesel particulate filter": "additive",
    "[ECM] Mileage since last diesel particulate filter replacement": "dpf_km",
    "[ECM] Exhaust gas temperature before pre-catalytic converter": "egt_b",
    "[ECM] Exhaust gas temperature after pre-catalytic converter": "egt_a",
    "[ECM] EGT before turbo": "egt_pre",
    "[ECM] EGT at DPF inlet": "egt_dpf_i",
    "[ECM] EGT at DPF outlet": "egt_dpf_o",
    "[ECM] Exhaust gas pressure at the outlet of the particulate filter": "exh_p",
    "[ECM] NOx content measured at the inlet of the NOx catalytic converter": "nox_in",
    "[ECM] Calculated NOx content at the inlet of the NOx catalytic converter": "nox_calc",
    "[ECM] Temperature of the NOx catalytic converter": "nox_t",
    "[ECM] NOx catalytic converter urea content": "urea",
    "[ECM] Urea mass fraction": "urea_pct",
    "[ECM] Remaining urea solution in the urea tank": "urea_rem",
    "[ECM] Volume of urea solution measured in urea tank": "urea_v",
    "[ECM] Vehicle mileage remaining before filling the tank with urea solution": "urea_km",
    "[ECM] Evaluation of the exhaust gas flow using the NOx sensor": "exh_nox",
    "[ECM] Evaluation of the degree of dilution of motor oil": "oil_dil",
    "[ECM] Evaluation of carbon content in engine oil": "oil_carb",
    "[ECM] Distance remaining until the next oil change": "oil_km",
    "[ECM] Oil level sensor": "oil_lvl",
    "[ECM] Minimum battery voltage at startup": "bat_v",
    "[ECM] Battery current": "bat_i",
    "[ECM] Alternator load value": "alt",
    "[ECM] Service battery charge status": "bat_soc",
    "[ECM] Stop and Start function state": "ss_state",
    "[ECM] Engine restart counter by Stop and Start function": "ss_count",
    "[ECM] Engine stop time": "ss_stop",
    "[ECM] Cruise control set speed": "cc_set",
    "[TCU] Selected gear": "gear",
    "[ECM] Clutch pedal switch": "clutch",
    "[ECM] Brake pedal switch": "brake",
    "Altitudine GPS": "gps_alt",
    "Accuratezza GPS": "gps_acc",
    "Direzione GPS": "gps_brg",
    "[ECM] Total mileage": "odo",
    "Distanza percorsa:": "odo",
}

# -- fixed values: byte-swap correction, sensor name to (div, mul, ofs) --------
CORRECTIONS = {
    "[ECM] Distance traveled since the last regeneration": (16.0, 1.0, 0.0),
    "[ECM] Average mileage for the last 10 regenerations": (16.0, 1.0, 0.0),
    "[ECM] Soot clogging level of diesel particulate filter": (10.24, 1.0, 0.0),
    "[ECM] Open loop soot load assessment of the diesel particulate filter": (1024.0, 1.0, 0.0),
    "[ECM] EGR valve position": (100.0, 1.0, 0.0),
    "[ECM] Air metering valve position": (100.0, 1.0, 0.0),
    "[ECM] NOx content measured at the inlet of the NOx catalytic converter": (1.0, 0.1, 0.0),
    "[ECM] Total mass of additive accumulated in the diesel particulate filter": (128.0, 1.0, 0.0),
    "[ECM] Mileage remaining before diesel particulate filter replacement": (1.0, 16.0, 0.0),
}

# -- fixed values: sensors that mark the engine-on window, in priority order ---
ENGINE_ANCHORS = [
    "Giri motore",
    "[ECM] Crankshaft speed",
    "Velocità veicolo",
    "[ECM] Vehicle speed",
    "Distanza percorsa:",
]

# -- fixed values: sensors used for fuel and distance --------------------------
FUEL_RATE = "[ECM] Fuel consumption rate"
GPS_SPEED = "Velocità (GPS)"
ODOMETER = "[ECM] Total mileage"
TRIP_COUNTER = "Distanza percorsa:"

# -- fixed values: trip field, aggregate, sensors in fallback order ------------
TRIP_FIELDS = [
    ("avg_speed_kmh", "mean", ["Velocità (GPS)"]),
    ("max_speed_kmh", "max", ["Velocità (GPS)"]),
    ("avg_rpm", "mean", ["Giri motore", "[ECM] Crankshaft speed"]),
    ("max_rpm", "max", ["Giri motore", "[ECM] Crankshaft speed"]),
    ("coolant_max_c", "max", ["Temperatura liquido raffreddamento motore",
                              "[ECM] Coolant temperature, corrected"]),
    ("oil_temp_max_c", "max", ["[ECM] Oil temperature"]),
    ("odometer_km", "last", ["[ECM] Total mileage", "Distanza percorsa:"]),
    ("air_temp_c", "first", ["Temperatura d'aria ambiente", "[ECM] Outside air temperature",
                             "[ECM] Intake air temperature"]),
    ("dpf_soot_pct", "last", ["[ECM] Soot clogging level of diesel particulate filter"]),
    ("dpf_closed_soot", "last",
     ["[ECM] Closed loop soot load assessment of the diesel particulate filter"]),
    ("dpf_regen_status", "max", ["[ECM] DPF regeneration status"]),
    ("dpf_regen_enable", "max", ["[ECM] Regeneration enable"]),
    ("dpf_regen_capability", "last", ["[ECM] Long-term regeneration capability"]),
    ("dpf_regen_capability_st", "last", ["[ECM] Short-term regeneration capability"]),
    ("dpf_since_regen_km", "last", ["[ECM] Distance traveled since the last regeneration"]),
    ("dpf_avg_regen_km", "last", ["[ECM] Average mileage for the last 10 regenerations"]),
    ("dpf_replace_km", "last",
     ["[ECM] Mileage remaining before diesel particulate filter replacement"]),
    ("adblue_vol_l", "last", ["[ECM] Volume of urea solution measured in urea tank"]),
    ("adblue_range_km", "last",
     ["[ECM] Vehicle mileage remaining before filling the tank with urea solution"]),
    ("exhaust_before_cat_c", "max",
     ["[ECM] Exhaust gas temperature before pre-catalytic converter"]),
    ("exhaust_after_cat_c", "max",
     ["[ECM] Exhaust gas temperature after pre-catalytic converter"]),
    ("nox_cat_temp_max_c", "max", ["[ECM] Temperature of the NOx catalytic converter"]),
    ("battery_startup_v", "last", ["[ECM] Minimum battery voltage at startup"]),
    ("oil_dilution_pct", "last", ["[ECM] Evaluation of the degree of dilution of motor oil"]),
    ("ss_state", "last", ["[ECM] Stop and Start function state"]),
    ("distance_km_raw", "last", ["Distanza percorsa:"]),
]

# -- fixed values: digits of the stored trip fields ----------------------------
TRIP_FIELD_DIGITS = {
    "avg_speed_kmh": 1, "max_speed_kmh": 1, "coolant_max_c": 1, "oil_temp_max_c": 1,
    "air_temp_c": 1, "dpf_soot_pct": 1, "dpf_closed_soot": 2, "dpf_regen_capability": 1,
    "dpf_regen_capability_st": 1, "dpf_since_regen_km": 1, "dpf_avg_regen_km": 1,
    "dpf_replace_km": 0, "adblue_vol_l": 2, "adblue_range_km": 0, "exhaust_before_cat_c": 1,
    "exhaust_after_cat_c": 1, "nox_cat_temp_max_c": 1, "battery_startup_v": 2,
    "oil_dilution_pct": 2,
}

# -- fixed values: sensors of the particulate filter state ---------------------
DPF_SENSORS = {
    "status": "[ECM] DPF regeneration status",
    "enable": "[ECM] Regeneration enable",
    "egt_after": "[ECM] Exhaust gas temperature after pre-catalytic converter",
    "nox_cat": "[ECM] Temperature of the NOx catalytic converter",
    "inlet": "[ECM] EGT at DPF inlet",
    "outlet": "[ECM] EGT at DPF outlet",
    "soot": "[ECM] Closed loop soot load assessment of the diesel particulate filter",
    "distance": "[ECM] Distance traveled since the last regeneration",
}
COOLANT = "Temperatura liquido raffreddamento motore"

# -- fixed values: sensor names that are bookkeeping noise ---------------------
NOISE_PATTERN = (
    r"(?i)(?:^|\b)mp_[a-z]|"
    r"first electronic|interface unit operating|in the process of adjust|"
    r"wear condition|controlled air supply module|auxiliary heater|"
    r"additional heater|abs/eks|restart request|restart control|"
    r"inhibition transmitted|inhibit control|allowed stop|allowed by|"
    r"permission from|permission based|return to (?:engine|starter)|"
    r"network related engine restart"
)

# -- fixed values: sensor group and the words that select it, in test order ----
SENSOR_GROUPS = [
    ("DPF", ["dpf", "particulate", "soot", "regen"]),
    ("Scarico", ["egt", "exhaust", "cat", "scarico"]),
    ("NOx/AdBlue", ["nox", "adblue", "urea"]),
    ("Olio", ["oil", "olio"]),
    ("Batteria", ["bat", "battery", "alt", "soc"]),
    ("Carburante", ["fuel", "carburante", "injection", "lambda", "inj", "rail"]),
    ("Aspirazione", ["turbo", "boost", "egr", "amv", "maf", "vgt", "aspiraz"]),
    ("Comfort", ["stop", "start", "ss_", "cruise", "gear", "clutch", "brake"]),
    ("GPS", ["gps", "altitud", "direzione", "accuratezza"]),
    ("Odometro", ["odometer", "mileage", "distanza"]),
    ("Motore", ["rpm", "crankshaft", "giri", "velocit", "speed", "coolant", "raffreddamento",
                "temperature", "temperatura", "load", "throttle", "torque"]),
]
OTHER_GROUP = "Sensori"
SHORT_NAME_PREFIXES = ["[ECM] ", "[TCU] ", "[ECM]", "[TCU]"]

# -- fixed values: month abbreviations and the missing-date mark ---------------
MONTHS = ["gen", "feb", "mar", "apr", "mag", "giu", "lug", "ago", "set", "ott", "nov", "dic"]
MISSING = "—"

# -- fixed values: states of the particulate filter ----------------------------
DPF_STATES = ["idle", "requested", "active", "completed", "post_regen"]
REGEN_STATES = ["active", "requested", "completed", "post_regen"]

# -- fixed values: binary log markers ------------------------------------------
BINARY_RECORD_MARK = b"\x50\x43\x27\x01"
BINARY_CATALOG_MARK = b"\x90\x61\xd5\x00"
BINARY_ALTITUDE_ID = b"\x30\x03\x03\x00"

# -- fixed values: message templates of the per-trip rules ---------------------
TRIP_MESSAGES = {
    "fuel_good": ("Viaggio efficiente · %.1f km/L",
                  "Il %.0f%% meglio della tua media (%.1f km/L). Guida fluida e percorso scorrevole."),
    "fuel_bad": ("Consumo elevato · %.1f km/L",
                 "Il %.0f%% sotto la tua media (%.1f km/L). "
                 "Tipico di traffico, partenza a freddo o tragitto urbano."),
    "fuel_normal": ("Consumo nella norma · %.1f km/L", "In linea con la tua media (%.1f km/L)."),
    "fuel_plain": ("Consumo · %.1f km/L", "≈ %.1f L/100 km su questo viaggio."),
    "cold_start": ("Partenza a freddo", "Avvio a ~%.0f°C ambiente; liquido salito a %.0f°C — %s."),
    "cold_warmed": "temperatura di esercizio raggiunta",
    "cold_not_warmed": "motore non del tutto in temperatura, consumo penalizzato",
    "regen_active": ("Rigenerazione DPF in corso", "Rigenerazione attiva durante il viaggio%s"
                     " Non spegnere il motore se possibile, per farla completare."),
    "regen_active_egt": ", EGT fino a %.0f°C.",
    "regen_active_no_egt": ".",
    "regen_completed": ("Rigenerazione DPF completata",
                        "Ciclo completato con successo: il soot è stato bruciato. "
                        "Il contatore km riparte da zero."),
    "regen_short": ("Rigenerazione richiesta ma viaggio breve",
                    "L'ECU ha richiesto una rigenerazione ma il tragitto è troppo corto per "
                    "raggiungere le temperature. Ripetuti viaggi brevi accumulano soot."),
    "regen_requested": ("Rigenerazione DPF richiesta", "Richiesta in corso%s. "
                        "Un tratto a velocità costante (extraurbano) aiuta a completarla."),
    "regen_requested_egt": ", EGT post-cat %.0f°C",
    "regen_post": ("Post-rigenerazione", "Rigenerazione completata poco prima di questo viaggio."),
    "soot_short": ("Viaggio breve con soot in accumulo",
                   "Solo %.1f km e closed soot a %.1f g/L senza rigenerazione. "
                   "Programma ogni tanto un tratto extraurbano per far pulire il filtro."),
    "soot_high": ("Closed soot alto · %.1f g/L",
                  "Vicino alla soglia di rigenerazione: attesa a breve."),
    "egt": ("Picco EGT %.0f°C",
            "Temperatura gas di scarico elevata, compatibile con guida sostenuta."),
    "oil": ("Diluizione olio %.1f%%",
            "Livello elevato: verifica frequenza/completamento rigenerazioni e valuta cambio olio."),
    "stop_start": ("Stop&Start — guasto",
                   "Il sistema Stop&Start ha riportato un guasto. Diagnostica consigliata."),
}

# -- fixed values: message templates of the per-vehicle rules ------------------
VEHICLE_MESSAGES = {
    "next_regen": ("Prossima rigenerazione DPF",
                   "%.0f km dall'ultima · intervallo medio %.0f km (%.0f%% del ciclo). "
                   "Stimata tra ~%.0f km."),
    "regen_overdue": ("Rigenerazione DPF imminente",
                      "Già %.0f km dall'ultima, oltre l'intervallo medio (%.0f km). "
                      "Favorisci un tratto extraurbano."),
    "soot": "Closed soot %.1f g/L",
    "soot_high": "Carico soot alto: rigenerazione attesa a breve. "
                 "Evita di interrompere il viaggio se parte.",
    "soot_normal": "Il filtro si svuota con la rigenerazione intorno a ~8 g/L. Valore nella norma.",
    "economy": ("Efficienza carburante",
                "Media %.1f km/L su %d viaggi · miglior viaggio %.1f km/L (%s)."),
    "economy_worse": " Ultimi 5 viaggi %.1f km/L, %.0f%% sotto lo storico (%.1f): "
                     "controlla pneumatici, filtri o stile di guida.",
    "economy_better": " In miglioramento: ultimi 5 a %.1f km/L.",
    "cost": ("Spesa carburante", "€%.2f/100 km in media · €%.0f totali su %d viaggi."),
    "cost_recent": " Ultimi 30 giorni: €%.0f (%d viaggi).",
    "battery_bad": ("Tensione di spunto %.2f V",
                    "Minimo all'avviamento in calo (media %.2f V). "
                    "Batteria possibilmente in invecchiamento: valuta un test di carico."),
    "battery_ok": ("Batteria · spunto %.2f V",
                   "Minimo all'avviamento stabile (media %.2f V su %d avvii)."),
    "oil": "Diluizione olio %.1f%%",
    "oil_bad": "In aumento o elevata: spesso legata a rigenerazioni interrotte. "
               "Monitora il livello olio.",
    "oil_ok": "Carburante nell'olio sotto controllo (allarme oltre ~5%).",
    "adblue": "AdBlue · %.0f km",
    "adblue_low": "Autonomia in calo: pianifica un rabbocco per evitare il blocco motore.",
    "adblue_ok": "Autonomia urea ampia, nessuna azione necessaria.",
    "service_due": ("Tagliando in avvicinamento", "Mancano %.0f km%s. Prenota l'intervento in officina."),
    "service_due_days": " o %d giorni",
    "service_ok": ("Tagliando", "Prossimo tra %.0f km%s."),
    "service_ok_days": " / %d giorni",
}

# -- fixed values: cloud alert about the filter and its two messages -----------
DPF_ALERT_CODE = 27
DPF_ALERT_CONFIRMED = "Allerta DPF (cod. 27) confermata da OBD: intasamento al %.0f%%"
DPF_ALERT_UNCONFIRMED = ("Allerta DPF (cod. 27) da Opel — "
                         "dati OBD non disponibili per questo viaggio")

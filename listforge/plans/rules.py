"""Fixed values of the listing engine: columns, rules and vocabularies, as plain data."""

from __future__ import annotations

# These must equal the values of the data contract for right results.

ARS_PER_USD, UYU_PER_USD = 1500, 40
MIN_SALE_USD_PAGES, MIN_SALE_USD_DUMPS = 20_000, 30_000
DESCRIPTION_CHARS, RAW_TEXT_CHARS, BLOCK_SAMPLE_CHARS, TYPE_SAMPLE_CHARS, LOCATION_SAMPLE_CHARS = 1200, 50_000, 2000, 800, 1200

#: name, domain_key, country, sale_paths, apartment_paths, detail_patterns, useful_words
SITES = (
    {
        'name': 'argenprop',
        'domain_key': 'argenprop.com',
        'country': 'AR',
        'sale_paths': ('/departamentos/venta/argentina', '/departamentos/venta/capital-federal', '/departamentos/venta/buenos-aires', '/departamentos/venta/gba-norte', '/departamentos/venta/gba-sur', '/departamentos/venta/gba-oeste', '/departamentos/venta/palermo', '/departamentos/venta/belgrano', '/departamentos/venta/caballito', '/casas/venta/argentina', '/terrenos/venta/argentina', '/departamentos-en-venta', '/casas-en-venta', '/terrenos-en-venta', '/inmuebles-en-venta', '/'),
        'apartment_paths': ('/departamentos/venta/argentina', '/departamentos/venta/capital-federal', '/departamentos/venta/buenos-aires', '/departamentos/venta/gba-norte', '/departamentos/venta/gba-sur', '/departamentos/venta/gba-oeste', '/departamentos/venta/palermo', '/departamentos/venta/belgrano', '/departamentos/venta/caballito', '/departamentos-en-venta'),
        'detail_patterns': ('--\\d+(?:$|[/?])',),
        'useful_words': ('venta', 'departamento', 'casa', 'terreno', 'inmueble'),
    },
    {
        'name': 'zonaprop',
        'domain_key': 'zonaprop.com.ar',
        'country': 'AR',
        'sale_paths': ('/departamentos-venta.html', '/departamentos-venta-capital-federal.html', '/departamentos-venta-gba-norte.html', '/departamentos-venta-gba-sur.html', '/departamentos-venta-gba-oeste.html', '/departamentos-venta-palermo.html', '/departamentos-venta-belgrano.html', '/departamentos-venta-caballito.html', '/casas-venta.html', '/terrenos-venta.html', '/inmuebles-venta.html'),
        'apartment_paths': ('/departamentos-venta.html', '/departamentos-venta-capital-federal.html', '/departamentos-venta-gba-norte.html', '/departamentos-venta-gba-sur.html', '/departamentos-venta-gba-oeste.html', '/departamentos-venta-palermo.html', '/departamentos-venta-belgrano.html', '/departamentos-venta-caballito.html'),
        'detail_patterns': ('/propiedades/.*\\.html(?:$|[/?])', '/.*-\\d{6,}\\.html(?:$|[/?])'),
        'useful_words': ('venta', 'departamento', 'casa', 'terreno', 'propiedades'),
    },
    {
        'name': 'infocasas',
        'domain_key': 'infocasas.com.uy',
        'country': 'UY',
        'sale_paths': ('/venta/apartamentos', '/venta/apartamentos/montevideo', '/venta/apartamentos/punta-del-este', '/venta/apartamentos/pocitos', '/venta/apartamentos/cordon', '/venta/apartamentos/malvin', '/venta/apartamentos/carrasco', '/venta/inmuebles', '/venta/casas', '/venta/terrenos'),
        'apartment_paths': ('/venta/apartamentos', '/venta/apartamentos/montevideo', '/venta/apartamentos/punta-del-este', '/venta/apartamentos/pocitos', '/venta/apartamentos/cordon', '/venta/apartamentos/malvin', '/venta/apartamentos/carrasco'),
        'detail_patterns': ('/\\d{6,}(?:$|[/?])',),
        'useful_words': ('venta', 'apartamento', 'casa', 'terreno', 'inmuebles'),
    },
    {
        'name': 'gallito',
        'domain_key': 'gallito.com.uy',
        'country': 'UY',
        'sale_paths': ('/inmuebles/apartamentos/venta', '/inmuebles/apartamentos/venta/montevideo', '/inmuebles/apartamentos/venta/punta-del-este', '/inmuebles/casas/venta', '/inmuebles/terrenos/venta', '/inmuebles/venta'),
        'apartment_paths': ('/inmuebles/apartamentos/venta', '/inmuebles/apartamentos/venta/montevideo', '/inmuebles/apartamentos/venta/punta-del-este'),
        'detail_patterns': ('/[^/?#]+-inmuebles-\\d+(?:$|[/?])', '/inmuebles/.+\\d+(?:$|[/?])', '/aviso/.+\\d+(?:$|[/?])'),
        'useful_words': ('venta', 'apartamento', 'casa', 'terreno', 'inmuebles'),
    },
)

BASE_COLUMNS = (
    'source_url',
    'source_domain',
    'listing_id',
    'listing_title',
    'description',
    'scraped_at',
    'data_source',
    'country',
    'operation_type',
    'property_type',
    'property_subtype',
    'publication_type',
    'construction_stage',
    'province',
    'city',
    'neighborhood',
    'location_key',
    'street',
    'balcony_type',
    'view_type',
    'flooring_type',
    'orientation',
    'price_usd',
    'price_original',
    'price_currency',
    'expenses_usd',
    'expenses_original',
    'expenses_currency',
    'total_rooms',
    'bedrooms',
    'bathrooms',
    'parking_spaces',
    'toilets',
    'covered_area_sqm',
    'total_area_sqm',
    'semicovered_area_sqm',
    'uncovered_area_sqm',
    'lot_frontage_sqm',
    'lot_length_sqm',
    'age_years',
    'number_of_floors_in_unit',
    'floors_in_building',
    'units_per_floor',
    'floor_number',
    'latitude',
    'longitude',
    'distance_to_sea_blocks',
    'effective_area_sqm',
    'area_per_room_sqm',
    'bedrooms_per_bathroom',
    'bathrooms_per_bedroom',
    'amenity_count',
    'core_feature_count',
    'title_length_chars',
    'description_length_chars',
    'title_word_count',
    'description_word_count',
    'area_bucket',
    'age_bucket',
    'floor_bucket',
    'room_bucket',
)

FLAG_COLUMNS = (
    'accepts_swap',
    'has_apartment_balcony_view',
    'has_air_conditioning',
    'has_alarm',
    'has_attic',
    'has_back_garden',
    'has_backyard',
    'has_balcony',
    'has_basement',
    'has_bbq_house',
    'has_breakfast_room',
    'has_cable_tv',
    'has_cleaning_service',
    'has_closet',
    'has_coordinates',
    'has_cooling',
    'has_description',
    'has_dining_room',
    'has_doorman',
    'has_double_circulation',
    'has_dressing_room',
    'has_electricity',
    'has_elevator',
    'has_extra_bedroom',
    'has_exact_address',
    'has_expenses',
    'has_football_court',
    'has_front_garden',
    'has_gallery',
    'has_garage_room',
    'has_garden',
    'has_grill',
    'has_gym',
    'has_hall',
    'has_heating',
    'has_hot_water',
    'has_internet',
    'has_jacuzzi',
    'has_kitchen',
    'has_kitchen_dining',
    'has_laundry_room',
    'has_library',
    'has_living_dining_room',
    'has_living_room',
    'has_maid_room',
    'has_master_suite',
    'has_multipurpose_room',
    'has_natural_gas',
    'has_office',
    'has_patio',
    'has_phone_line',
    'has_play_room',
    'has_pool',
    'has_private_landing',
    'has_property_tax_service',
    'has_radiant_floor',
    'has_reception',
    'has_rentas_paid',
    'has_running_water',
    'has_sauna',
    'has_sea_view',
    'has_security',
    'has_storage_room',
    'has_studio_room',
    'has_tennis_court',
    'has_terrace',
    'has_toilette_room',
    'has_walk_in_closet',
    'has_water_heater',
    'has_wood_stove',
    'has_virtual_tour',
    'is_accessible',
    'is_apartment',
    'is_back_facing',
    'is_bright',
    'is_currently_occupied',
    'is_development_project',
    'is_duplex',
    'is_high_floor',
    'is_front_facing',
    'is_furnished',
    'is_gated_community',
    'is_negotiable',
    'is_new_construction',
    'is_near_beach',
    'is_near_park',
    'is_near_sea',
    'is_near_subway',
    'is_owner_direct',
    'is_opportunity',
    'is_penthouse',
    'is_social_housing',
    'is_studio_apartment',
    'is_under_construction',
    'mortgage_eligible',
    'pets_allowed',
    'professional_use_allowed',
)

FLAG_PATTERNS = {
    'has_apartment_balcony_view': 'balc[oó]n\\s+(?:al\\s+)?(?:frente|contrafrente|vista)',
    'has_air_conditioning': 'aire\\s+acondicionado|air\\s*conditioning',
    'has_alarm': '\\balarma\\b|alarm',
    'has_attic': '\\baltillo\\b|attic',
    'has_back_garden': 'jard[ií]n\\s+fondo',
    'has_backyard': '\\bfondo\\b|backyard',
    'has_balcony': 'balc[oó]n|balcony',
    'has_basement': 's[oó]tano|basement',
    'has_bbq_house': '\\bbarbacoa\\b|\\bquincho\\b',
    'has_breakfast_room': 'comedor\\s+diario',
    'has_cable_tv': 'cable\\s*tv|video\\s*cable',
    'has_cleaning_service': 'servicio\\s+de\\s+limpieza|limpieza',
    'has_closet': '\\bplacard(?:s)?\\b|closet',
    'has_cooling': 'refrigeraci[oó]n',
    'has_dining_room': '\\bcomedor\\b|dining',
    'has_doorman': 'portero|conserje|encargado|porter[ií]a',
    'has_double_circulation': 'doble\\s+circulaci[oó]n',
    'has_dressing_room': '\\bvestuario\\b',
    'has_electricity': 'electricidad|electricity',
    'has_elevator': 'ascensor(?:es)?|elevator',
    'has_extra_bedroom': 'dormitorio\\s+extra',
    'has_football_court': 'cancha\\s+de\\s+f[uú]tbol',
    'has_front_garden': 'jard[ií]n\\s+frente',
    'has_gallery': '\\bgaler[ií]a\\b',
    'has_garage_room': '\\bcochera\\b|\\bgaraje\\b|garage',
    'has_garden': 'jard[ií]n|garden',
    'has_grill': 'parrillero|parrilla|grill',
    'has_gym': 'gimnasio|\\bgym\\b',
    'has_hall': '\\bhall\\b',
    'has_heating': 'calefacci[oó]n|heating',
    'has_hot_water': 'agua\\s+caliente',
    'has_internet': 'internet|wifi|wi-fi',
    'has_jacuzzi': 'hidromasaje|jacuzzi',
    'has_kitchen': '\\bcocina\\b|kitchen',
    'has_kitchen_dining': 'cocina\\s+comedor',
    'has_laundry_room': 'lavadero|laundry',
    'has_library': 'biblioteca|library',
    'has_living_dining_room': 'living\\s+comedor',
    'has_living_room': '\\bliving\\b',
    'has_maid_room': 'dependencia\\s+de\\s+servicio|dependencia',
    'has_master_suite': 'suite|dormitorio\\s+en\\s+suite',
    'has_multipurpose_room': '\\bsum\\b|sal[oó]n\\s+de\\s+usos\\s+m[uú]ltiples|sal[oó]n\\s+comunal',
    'has_natural_gas': 'gas\\s+natural',
    'has_office': 'escritorio|estudio|home\\s*office',
    'has_patio': '\\bpatio\\b',
    'has_phone_line': 'tel[eé]fono|phone',
    'has_play_room': 'playroom|sala\\s+de\\s+juegos',
    'has_pool': 'piscina|pileta|pool',
    'has_private_landing': '\\bpalier\\b',
    'has_property_tax_service': '\\babl\\b|contribuci[oó]n',
    'has_radiant_floor': 'losa\\s+radiante',
    'has_reception': 'recepci[oó]n',
    'has_rentas_paid': '\\brentas\\b',
    'has_running_water': 'agua\\s+corriente',
    'has_sauna': '\\bsauna\\b',
    'has_sea_view': 'vista\\s+al\\s+mar|sea\\s+view',
    'has_security': 'seguridad|vigilancia|24\\s*hs|security',
    'has_storage_room': 'baulera|dep[oó]sito|storage',
    'has_studio_room': '\\bestudio\\b',
    'has_tennis_court': 'cancha\\s+de\\s+tenis',
    'has_terrace': 'terraza|terrace',
    'has_toilette_room': 'toilette',
    'has_virtual_tour': 'tour\\s+virtual|recorrido\\s+virtual|video\\s+tour',
    'has_walk_in_closet': 'vestidor|walk[-\\s]?in',
    'has_water_heater': 'calef[oó]n|termotanque|water\\s+heater',
    'has_wood_stove': 'estufa\\s+a\\s+le[nñ]a',
    'is_accessible': 'acceso\\s+para\\s+personas|movilidad\\s+reducida|accessible',
    'is_back_facing': 'contrafrente',
    'is_bright': 'luminos[oa]|bright',
    'is_currently_occupied': 'propiedad\\s+ocupada',
    'is_development_project': 'emprendimiento|desarrollo|proyecto',
    'is_duplex': '\\bd[uú]plex\\b|\\bduplex\\b',
    'is_front_facing': '\\bfrente\\b',
    'is_furnished': 'amoblado|amueblado|furnished',
    'is_gated_community': 'barrio\\s+privado|country\\s+club',
    'is_near_beach': 'playa|beach',
    'is_near_park': 'parque|plaza|park',
    'is_near_sea': '\\bmar\\b|sea',
    'is_near_subway': 'subte|metro|estaci[oó]n',
    'is_negotiable': 'negociable',
    'is_opportunity': 'oportunidad',
    'is_penthouse': 'penthouse|[áa]tico',
    'is_social_housing': 'vivienda\\s+social',
    'is_studio_apartment': 'monoambiente|studio',
    'mortgage_eligible': 'apto\\s+cr[eé]dito|acepta\\s+banco|financiaci[oó]n',
    'pets_allowed': 'mascotas|pet\\s*friendly',
    'professional_use_allowed': 'apto\\s+profesional|apto\\s+para\\s+oficina',
    'accepts_swap': 'acepta\\s+permuta|permuta',
}

PROPERTY_TYPES = (
    (r"\b(departamento|apartamento|apartment|monoambiente)\b", "Apartment"),
    (r"\b(casa|house|chalet)\b", "House"),
    (r"\b(ph)\b", "PH"),
    (r"\b(terreno|lote|land)\b", "Land"),
    (r"\b(oficina|office)\b", "Office"),
    (r"\b(local comercial|local|retail)\b", "Commercial Space"),
    (r"\b(cochera|garage|garaje)\b", "Parking Space"),
    (r"\b(campo|chacra|farm)\b", "Farm"),
)
SUBTYPES = (("monoambiente|studio", "Studio"), (r"\bd[uú]plex\b|\bduplex\b", "Duplex"), ("penthouse|[áa]tico", "Penthouse"), ("semipiso", "Semi-floor Apartment"), (r"piso\s+completo", "Full-floor Apartment"))
STAGES = ((r"\ba\s+estrenar\b|brand\s+new", "new"), (r"en\s+pozo|en\s+construcci[oó]n|under\s+construction", "under_construction"), ("reciclado|refaccionado|renovado", "renovated"), ("usado|antig[uü]edad", "resale"))
PUBLICATIONS = ((r"due[nñ]o\s+directo|owner\s+direct", "owner_direct"), ("desarrollador|desarrolladora|emprendimiento|proyecto", "developer"), (r"inmobiliaria|broker|real\s+estate", "agency"))
BLOCKED = (r"verify that you(?:'| a)?re not a robot", "captcha", "just a moment", "cloudflare", "javascript is disabled", "access denied")
NOT_COUNTED = ("has_coordinates", "has_description", "has_exact_address", "has_expenses")
CORE_FIELDS = ("bedrooms", "bathrooms", "covered_area_sqm", "total_area_sqm", "parking_spaces", "age_years")
MAXIMA = {"total_rooms": 20, "bedrooms": 10, "bathrooms": 10, "parking_spaces": 10, "toilets": 10, "covered_area_sqm": 2000, "total_area_sqm": 5000, "semicovered_area_sqm": 1000, "uncovered_area_sqm": 5000, "age_years": 250, "floor_number": 100, "distance_to_sea_blocks": 500, "expenses_usd": 20000}
AREA_BUCKETS = ((30, "01_tiny"), (50, "02_small"), (80, "03_medium"), (120, "04_large"), (200, "05_extra_large"), (10000, "06_luxury_scale"))
AGE_BUCKETS = ((0, "01_new"), (10, "02_1_to_10"), (30, "03_11_to_30"), (60, "04_31_to_60"), (300, "05_60_plus"))
FLOOR_BUCKETS = ((0, "01_ground"), (3, "02_low"), (8, "03_mid"), (200, "04_high"))
COUNTS = {
    "total_rooms": (r"(\d+(?:[.,]\d+)?)\s*ambientes?", r"(\d+(?:[.,]\d+)?)\s*rooms?"),
    "bedrooms": (r"(\d+(?:[.,]\d+)?)\s*dormitorios?", r"(\d+(?:[.,]\d+)?)\s*dorms?\.?", r"(\d+(?:[.,]\d+)?)\s*bedrooms?"),
    "bathrooms": (r"(\d+(?:[.,]\d+)?)\s*ba[ñn]os?", r"(\d+(?:[.,]\d+)?)\s*bathrooms?"),
    "parking_spaces": (r"(\d+(?:[.,]\d+)?)\s*cocheras?", r"(\d+(?:[.,]\d+)?)\s*garajes?", r"(\d+(?:[.,]\d+)?)\s*parking"),
    "toilets": (r"(\d+(?:[.,]\d+)?)\s*toilettes?",),
    "age_years": (r"(\d+)\s*a[ñn]os?\s+de\s+antig[uü]edad", r"antig[uü]edad[^\d]{0,15}(\d+)"),
    "floor_number": (r"piso[^\d]{0,8}(\d+)", r"(\d+)[°º]?\s*piso"),
}
AREAS = {"covered_area_sqm": ("cubierta", "construidos", "edificados", "covered"), "total_area_sqm": ("total", "terreno", "superficie", "lote"), "semicovered_area_sqm": ("semicubierta", "semi cubierta"), "uncovered_area_sqm": ("descubierta", "uncovered")}
PRICES = ((r"(?:U\$S|US\$|USD)\s*([\d.,]+)", "USD"), (r"(?:ARS|AR\$)\s*([\d.,]+)", "ARS"), (r"(?:UYU|\$U)\s*([\d.,]+)", "UYU"), (r"\$\s*([\d.,]{5,})", "$"))
CITY_SLUGS = {"montevideo": "Montevideo", "punta-del-este": "Punta del Este", "maldonado": "Maldonado", "canelones": "Canelones"}
NOT_PLACES = ("dormitorio", "dormitorios", "baño", "baños", "construcción", "descubra", "edificio", "exclusivo", "pregúntale", "ref #", "referencia", "venta en")

TYPE_NAMES = {
    'departamento': 'Apartment',
    'apartamento': 'Apartment',
    'casa': 'House',
    'ph': 'PH',
    'terreno': 'Land',
    'local': 'Commercial Space',
    'local comercial': 'Commercial Space',
    'oficina': 'Office',
    'quinta': 'Country House',
    'galpón': 'Warehouse',
    'galpon': 'Warehouse',
    'campo': 'Farm',
    'chacra': 'Farm',
    'chacra o campo': 'Farm',
    'hotel': 'Hotel',
    'cochera': 'Parking Space',
    'garaje': 'Parking Space',
}

AMENITIES = {
    'aire_acondicionado': 'has_air_conditioning',
    'alarma': 'has_alarm',
    'amoblado': 'is_furnished',
    'apto_credito': 'mortgage_eligible',
    'apto_profesional': 'professional_use_allowed',
    'ascensor': 'has_elevator',
    'balcon': 'has_balcony',
    'baulera': 'has_storage_room',
    'caldera': 'has_boiler',
    'calefaccion': 'has_heating',
    'cancha_de_deportes': 'has_sports_court',
    'cocina_equipada': 'has_equipped_kitchen',
    'comedor': 'has_dining_room',
    'comedor_diario': 'has_breakfast_room',
    'dependencia_de_servicio': 'has_maid_room',
    'dormitorio_en_suite': 'has_master_suite',
    'encargado': 'has_doorman',
    'escritorio': 'has_office',
    'estudio': 'has_studio_room',
    'gimnasio': 'has_gym',
    'hall': 'has_hall',
    'hidromasaje': 'has_jacuzzi',
    'iluminacion': 'has_lighting',
    'internet_wifi': 'has_internet',
    'internet': 'has_internet',
    'jardin': 'has_garden',
    'lavadero': 'has_laundry_room',
    'living': 'has_living_room',
    'living_comedor': 'has_living_dining_room',
    'luminoso': 'is_bright',
    'microondas': 'has_microwave',
    'parrilla': 'has_grill',
    'patio': 'has_patio',
    'permite_mascotas': 'pets_allowed',
    'pileta': 'has_pool',
    'quincho': 'has_bbq_house',
    'recepcion': 'has_reception',
    'ropa_de_cama': 'has_bedding',
    'sala_de_juegos': 'has_game_room',
    'solarium': 'has_solarium',
    'sum': 'has_multipurpose_room',
    'termotanque': 'has_water_heater',
    'terraza': 'has_terrace',
    'toallas': 'has_towels',
    'toilette': 'has_toilette_room',
    'uso_comercial': 'commercial_use_allowed',
    'vestidor': 'has_walk_in_closet',
    'vigilancia': 'has_security',
    'agua_corriente': 'has_running_water',
    'electricidad': 'has_electricity',
    'gas_natural': 'has_natural_gas',
    'abl': 'has_property_tax_service',
    'acceso_para_personas_con_movilidad_reducida': 'is_accessible',
    'cochera': 'has_garage_room',
    'dormitorio': 'has_extra_bedroom',
    'seguridad': 'has_security',
    'suite': 'has_master_suite',
    'palier': 'has_private_landing',
    'dependencia': 'has_maid_room',
    'galeria': 'has_gallery',
    'jardin_fondo': 'has_back_garden',
    'jardin_frente': 'has_front_garden',
    'sotano': 'has_basement',
    'altillo': 'has_attic',
    'biblioteca': 'has_library',
    'vestuario': 'has_dressing_room',
    'cocina_comedor': 'has_kitchen_dining',
    'video_cable': 'has_cable_tv',
    'telefono': 'has_phone_line',
    'refrigeracion': 'has_cooling',
    'limpieza': 'has_cleaning_service',
    'rentas': 'has_rentas_paid',
    'acepta_permuta': 'accepts_swap',
    'propiedad_ocupada': 'is_currently_occupied',
    'circulacion': 'has_double_circulation',
    'frente': 'is_front_facing',
    'disposicion_frente': 'is_front_facing',
    'barbacoa': 'has_bbq_house',
    'piscina': 'has_pool',
    'piscina_climatizada': 'has_heated_pool',
    'sauna': 'has_sauna',
    'gym': 'has_gym',
    'cocina_definida': 'has_kitchen',
    'placard': 'has_closet',
    'placards': 'has_closet',
    'estufa_a_lena': 'has_wood_stove',
    'estufa': 'has_heating',
    'portero_electrico': 'has_intercom',
    'portero': 'has_intercom',
    'conserje': 'has_doorman',
    'portico': 'has_porch',
    'cancha_de_tenis': 'has_tennis_court',
    'cancha_de_futbol': 'has_football_court',
    'losa_radiante': 'has_radiant_floor',
    'aire': 'has_air_conditioning',
    'playroom': 'has_play_room',
    'salon_de_usos_multiples': 'has_multipurpose_room',
    'salon_comunal': 'has_common_room',
    'ascensores': 'has_elevator',
    'ascensor_y_escalera': 'has_elevator',
    'cable': 'has_cable_tv',
    'calefon': 'has_water_heater',
    'fondo': 'has_backyard',
    'fondo_de_casa': 'has_backyard',
}

KEYWORDS = {
    'balc[oó]n': 'has_balcony',
    'terraza': 'has_terrace',
    'jardin|jard[ií]n': 'has_garden',
    'piscina': 'has_pool',
    'gimnasio|gym': 'has_gym',
    'parrillero|parrilla|barbacoa': 'has_grill',
    'ascensor': 'has_elevator',
    'seguridad|vigilancia|24\\s*hs': 'has_security',
    'amoblado|amueblado': 'is_furnished',
    'aire\\s*acondicionado': 'has_air_conditioning',
    'calefacci[oó]n': 'has_heating',
    'calef[oó]n': 'has_water_heater',
    'lavadero': 'has_laundry_room',
    'living': 'has_living_room',
    'comedor': 'has_dining_room',
    'vestidor': 'has_walk_in_closet',
    'sauna': 'has_sauna',
    'cancha\\s+de\\s+tenis': 'has_tennis_court',
    'cancha\\s+de\\s+f[uú]tbol': 'has_football_court',
    'barbacoa': 'has_bbq_house',
    'playroom': 'has_play_room',
    'sum\\b': 'has_multipurpose_room',
    'conserjeria|conserje|porter[ií]a': 'has_doorman',
    'estufa\\s+a\\s+le[nñ]a|estufa\\s+a\\s+lena': 'has_wood_stove',
    'losa\\s+radiante': 'has_radiant_floor',
    'video\\s+cable|cable\\s+tv': 'has_cable_tv',
    'internet|wifi': 'has_internet',
    'agua\\s+caliente': 'has_hot_water',
    'gas\\s+natural': 'has_natural_gas',
    'apto\\s+cr[ée]dito|acepta\\s+banco': 'mortgage_eligible',
    'placard': 'has_closet',
    'lumino[s]?o': 'is_bright',
    'frente': 'is_front_facing',
    'contrafrente': 'is_back_facing',
    'altillo': 'has_attic',
    'baulera': 'has_storage_room',
    'mascotas': 'pets_allowed',
    'negociable': 'is_negotiable',
    'oportunidad': 'is_opportunity',
}

DROPPED_AMENITIES = ("bano", "cocina")
SPAM_AMENITIES = ("gmail", "hola_vi", "contacten", "quiero", "gracias", "propiedad_en")
FLAG_PREFIXES = ("has_", "is_", "pets_", "mortgage_", "commercial_", "professional_", "accepts_")
ML_CATEGORICAL = ("data_source", "country", "property_type", "property_subtype", "province", "city", "neighborhood", "balcony_type", "view_type", "flooring_type", "orientation")
ML_NUMERIC = ("price_usd", "total_rooms", "bedrooms", "bathrooms", "parking_spaces", "toilets", "covered_area_sqm", "total_area_sqm", "semicovered_area_sqm", "uncovered_area_sqm", "lot_frontage_sqm", "lot_length_sqm", "age_years", "number_of_floors_in_unit", "floors_in_building", "units_per_floor", "floor_number", "latitude", "longitude")

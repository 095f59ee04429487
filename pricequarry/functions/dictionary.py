"""Words, brands and units by which product names are standardised.

Fixed values: results depend on them, so they stand here as they are.
"""

#: Usual slips of the pen.
MISSPELLINGS = {
    "poteto": "potato", "potatoe": "potato", "potatos": "potato", "potatoes": "potato", "tomato": "tomato", "tomatos": "tomato",
    "tomatoes": "tomato", "brocoly": "broccoli", "brocoli": "broccoli", "carots": "carrot", "carot": "carrot", "spinch": "spinach",
    "spinatch": "spinach", "cucmber": "cucumber", "cuccumber": "cucumber", "eggplan": "eggplant", "egglant": "eggplant", "cabage": "cabbage",
    "caabbage": "cabbage", "lettus": "lettuce", "lettuce": "lettuce", "bean": "bean", "beens": "bean", "banan": "banana", "bananna": "banana",
    "bannana": "banana", "aple": "apple", "appel": "apple", "orrange": "orange", "orage": "orange", "lemmon": "lemon", "limon": "lemon",
    "straberry": "strawberry", "strawbery": "strawberry", "pinapple": "pineapple", "pineaple": "pineapple", "advocado": "avocado",
    "avacado": "avocado", "avocato": "avocado", "chiken": "chicken", "chicke": "chicken", "beff": "beef", "beaf": "beef", "porck": "pork",
    "lamp": "lamb", "lam": "lamb", "shrim": "shrimp", "schrimp": "shrimp", "sqiud": "squid", "squids": "squid", "crap": "crab", "crabs": "crab",
    "yoghurt": "yogurt", "chese": "cheese", "cheeze": "cheese", "bred": "bread", "berad": "bread", "noodles": "noodle", "noddle": "noodle",
    "noddles": "noodle", "cofee": "coffee", "coffe": "coffee", "juise": "juice", "juce": "juice", "choclate": "chocolate", "chocholate": "chocolate",
    "chocolat": "chocolate",
}

#: Pairs of words that are one product, in the order in which they are replaced.
PHRASES = (
    (r"\b(?:mie|mi)\s+(?:instan|instant)\b", "instant-noodle"),
    (r"\bair\s+mineral\b", "mineral-water"),
    (r"\bes\s+krim\b", "ice-cream"),
    (r"\bkecap\s+manis\b", "sweet-soy-sauce"),
    (r"\bminyak\s+goreng\b", "cooking-oil"),
    (r"\bgula\s+pasir\b", "sugar"),
    (r"\bgula\s+merah\b", "palm-sugar"),
    (r"\bbawang\s+merah\b", "shallot"),
    (r"\bbawang\s+putih\b", "garlic"),
    (r"\bkacang\s+panjang\b", "long-bean"),
)

#: Indonesian products in English.
PRODUCTS = {
    "susu": "milk", "keju": "cheese", "yogurt": "yogurt", "yoghurt": "yogurt", "mentega": "butter", "krim": "cream", "eskrim": "ice-cream",
    "daging": "meat", "ayam": "chicken", "ikan": "fish", "udang": "shrimp", "cumi": "squid", "kepiting": "crab", "telur": "egg", "telor": "egg",
    "sayur": "vegetable", "sayuran": "vegetable", "tomat": "tomato", "kentang": "potato", "wortel": "carrot", "bawang": "onion", "kubis": "cabbage",
    "kol": "cabbage", "sawi": "mustard-green", "bayam": "spinach", "kangkung": "water-spinach", "terong": "eggplant", "timun": "cucumber",
    "labu": "pumpkin", "jagung": "corn", "buncis": "green-bean", "paprika": "bell-pepper", "cabe": "chili", "cabai": "chili", "buah": "fruit",
    "apel": "apple", "jeruk": "orange", "pisang": "banana", "kepok": "plantain", "mangga": "mango", "anggur": "grape", "semangka": "watermelon",
    "melon": "melon", "nanas": "pineapple", "pepaya": "papaya", "alpukat": "avocado", "durian": "durian", "rambutan": "rambutan",
    "kelapa": "coconut", "stroberi": "strawberry", "strawberry": "strawberry", "lemon": "lemon", "jambu": "guava", "nangka": "jackfruit",
    "manggis": "mangosteen", "salak": "snake-fruit", "beras": "rice", "nasi": "cooked-rice", "mie": "noodle", "mi": "noodle", "pasta": "pasta",
    "roti": "bread", "tepung": "flour", "gandum": "wheat", "minuman": "beverage", "air": "water", "jus": "juice", "kopi": "coffee", "teh": "tea",
    "sirup": "syrup", "soda": "soda", "garam": "salt", "gula": "sugar", "merica": "pepper", "lada": "pepper", "kecap": "soy-sauce",
    "sambal": "chili-sauce", "saus": "sauce", "mayones": "mayonnaise", "minyak": "oil", "cuka": "vinegar", "kerupuk": "cracker", "keripik": "chips",
    "biskuit": "biscuit", "kue": "cake", "permen": "candy", "coklat": "chocolate", "es": "ice", "madu": "honey",
}

#: Indonesian descriptions in English, for words that are no product.
DESCRIPTORS = {
    "merah": "red", "hijau": "green", "kuning": "yellow", "putih": "white", "hitam": "black", "biru": "blue", "ungu": "purple", "coklat": "brown",
    "oranye": "orange", "orange": "orange", "kepok": "plantain", "raja": "king", "ambon": "cavendish", "mas": "lady-finger", "uli": "cooking-banana",
    "baby": "baby", "besar": "large", "kecil": "small", "sedang": "medium", "jumbo": "jumbo", "mini": "mini", "segar": "fresh", "beku": "frozen",
    "kering": "dried", "manis": "sweet", "asin": "salty", "pedas": "spicy", "pahit": "bitter", "asam": "sour", "gurih": "savory",
    "organik": "organic", "alami": "natural", "murni": "pure", "matang": "ripe", "mentah": "raw", "goreng": "fried", "rebus": "boiled",
    "bakar": "grilled", "panggang": "roasted", "dada": "breast", "paha": "thigh", "sayap": "wing", "kepala": "head", "ekor": "tail",
    "fillet": "fillet", "potongan": "cut", "utuh": "whole", "kemasan": "package", "botol": "bottle", "kaleng": "can", "kardus": "box",
    "plastik": "plastic", "sachet": "sachet", "pack": "pack", "bundel": "bundle", "lusin": "dozen", "lokal": "local", "impor": "imported",
    "premium": "premium", "super": "super", "spesial": "special", "original": "original", "rasa": "flavor", "tanpa": "without", "dengan": "with",
    "rendah": "low", "tinggi": "high", "bebas": "free",
}

#: Words that a standard name begins with.
MAIN_PRODUCTS = (
    "milk", "yogurt", "cheese", "butter", "cream", "ice-cream", "chicken", "beef", "pork", "lamb", "fish", "shrimp", "egg", "rice", "noodle",
    "bread", "flour", "oil", "sugar", "salt", "water", "juice", "coffee", "tea", "soda", "sauce", "vegetable", "fruit", "meat", "instant-noodle",
    "mineral-water",
)

#: Brands, in the order in which they are tried.
BRANDS = (
    "indomie", "sedaap", "abc", "indofood", "unilever", "nestle", "danone", "aqua", "sosro", "pocari-sweat", "coca-cola", "pepsi", "sprite", "fanta",
    "minute-maid", "ultra", "diamond", "frisian-flag", "bear-brand", "silverqueen", "delfi", "kitkat", "oreo", "khongguan", "roma", "monde",
    "orang-tua", "mayora", "garuda", "dua-kelinci", "taro", "qtela", "chitato", "lays", "pringles", "mr-potato", "japota", "kusuka", "potabee",
)

#: Units as the service shows them.
SERVICE_UNITS = {
    "kg": "kg", "kilo": "kg", "kilogram": "kg", "kilograms": "kg", "g": "g", "gr": "g", "gram": "g", "grams": "g", "mg": "mg", "milligram": "mg",
    "lb": "lb", "lbs": "lb", "pound": "lb", "pounds": "lb", "oz": "oz", "ounce": "oz", "ounces": "oz", "ons": "oz", "l": "L", "ltr": "L",
    "liter": "L", "liters": "L", "litre": "L", "litres": "L", "ml": "mL", "milliliter": "mL", "milliliters": "mL", "mililiter": "mL", "pcs": "pcs",
    "pc": "pcs", "piece": "pcs", "pieces": "pcs", "unit": "pcs", "units": "pcs", "item": "pcs", "items": "pcs", "ea": "pcs", "each": "pcs",
    "buah": "pcs", "butir": "pcs", "biji": "pcs", "lembar": "sheet", "potong": "pcs", "ekor": "pcs", "pack": "pack", "packs": "pack",
    "package": "pack", "paket": "pack", "box": "box", "boxes": "box", "dus": "box", "karton": "carton", "carton": "carton", "bottle": "bottle",
    "bottles": "bottle", "botol": "bottle", "can": "can", "cans": "can", "kaleng": "can", "bag": "bag", "bags": "bag", "kantong": "bag",
    "bungkus": "pack", "bunch": "bunch", "bundle": "bundle", "sisir": "bunch", "ikat": "bundle", "k": "1000", "ribu": "1000", "rb": "1000",
    "lusin": "dozen", "dozen": "dozen", "kodi": "score", "gross": "gross", "rim": "ream", "ream": "ream",
}

#: Units that only whole texts are taken for.
MORE_UNITS = {
    "ijs": "pcs", "ijas": "pcs", "ijasan": "pcs", "ssr": "pcs", "sst": "pcs", "sheet": "sheet",
}

#: Units as an upload's store keeps them. Fixed values.
INGESTED_UNITS = {
    "kg": "kg", "kilogram": "kg", "kilograms": "kg", "kilo": "kg", "g": "g", "gram": "g", "grams": "g", "gr": "g", "lb": "lb", "pound": "lb",
    "pounds": "lb", "lbs": "lb", "oz": "oz", "ounce": "oz", "ounces": "oz", "l": "l", "liter": "l", "litre": "l", "liters": "l", "litres": "l",
    "ltr": "l", "ml": "ml", "milliliter": "ml", "milliliters": "ml", "pcs": "pcs", "piece": "pcs", "pieces": "pcs", "pc": "pcs", "each": "pcs",
    "item": "pcs", "unit": "pcs", "box": "box", "boxes": "box", "pack": "pack", "package": "pack", "packet": "pack", "bottle": "bottle",
    "bottles": "bottle", "btl": "bottle", "can": "can", "cans": "can", "sisir": "bunch", "ikat": "bunch", "bunch": "bunch", "bundle": "bunch",
}

#: Standard units that the quality checks accept. Fixed values.
VALID_UNITS = ("kg", "g", "mg", "lb", "oz", "L", "mL", "pcs", "sheet", "pack", "box", "carton", "bottle", "can", "bag", "bunch", "bundle", "1000", "dozen", "score", "gross", "ream")

#: Words that an English standard name should not hold. Fixed values.
UNTRANSLATED = ("apel", "wortel", "tomat", "bawang", "kentang", "ayam", "sapi", "ikan", "sayur", "buah", "daging", "telur", "gula", "garam", "minyak", "tepung", "beras")

#: Words by which a name is told to be Indonesian. Fixed values.
INDONESIAN = ("merah", "hijau", "putih", "kuning", "biru", "besar", "kecil", "sedang", "segar", "organik", "lokal", "buah", "sayur", "daging", "ikan")

#: How canonical units are shown where that differs. Fixed values.
SHOWN_UNITS = {"ltr": "L", "pak": "pack", "dus": "box"}

#: Suppliers that go by another name than their files'. Fixed values, the first that fits counts.
KNOWN_SUPPLIERS = {
    "Widi Wiguna": "Widi Wiguna", "Bali Boga Sejati": "Bali Boga", "Sai Fresh": "Sai Fresh", "Milk Up": "Milk Up", "Lestari Pangan": "Lestari Pangan",
    "Pangan Lestari": "Lestari Pangan", "Sutria Pangan Sejati": "Sutria Pangan Sejati", "Bali Seafood": "Bali_seafood", "Island Organics": "Island Organics Bali",
}

"""Rules from free-text places to regions and communities. Aggregates only, and never without the disclaimer."""

#: Fixed text that goes with every result by community.
DISCLAIMER = "Experimental: a stated place is no proof of a community. Aggregates only; wrong for single people and for mixed, urban and emigrant users."

#: The first rule with a token that the lower-case place contains decides.
REGION_RULES = [
    (["nairobi", "nbo", "cbd"], "Nairobi"),
    (["mombasa", "kilifi", "kwale", "lamu", "tana", "taita", "malindi", "coast", "pwani"], "Coast"),
    (["kisumu", "siaya", "homa bay", "homabay", "migori", "nyanza", "bondo", "kisii", "nyamira"], "Nyanza"),
    (["kakamega", "bungoma", "busia", "vihiga", "western", "mumias"], "Western"),
    (["eldoret", "uasin gishu", "kericho", "bomet", "nandi", "baringo", "marakwet", "nakuru", "narok", "kajiado", "rift"], "Rift Valley"),
    (["nyeri", "murang", "kiambu", "kirinyaga", "nyandarua", "thika", "central"], "Central"),
    (["machakos", "makueni", "kitui", "embu", "meru", "isiolo", "marsabit", "tharaka", "eastern"], "Eastern"),
    (["garissa", "wajir", "mandera", "north eastern", "northeastern"], "North Eastern"),
    (["turkana", "samburu", "west pokot", "lodwar"], "North Rift"),
]
COMMUNITY_RULES = [
    (["nyeri", "murang", "kiambu", "kirinyaga", "nyandarua", "thika"], "Kikuyu"),
    (["kisumu", "siaya", "homa bay", "homabay", "migori", "bondo"], "Luo"),
    (["kakamega", "bungoma", "busia", "vihiga", "mumias"], "Luhya"),
    (["eldoret", "uasin gishu", "kericho", "bomet", "nandi", "baringo", "marakwet"], "Kalenjin"),
    (["machakos", "makueni", "kitui"], "Kamba"),
    (["kisii", "nyamira"], "Kisii"),
    (["meru", "tharaka", "embu"], "Meru/Embu"),
    (["mombasa", "kilifi", "kwale", "lamu", "tana", "taita", "malindi"], "Coastal"),
    (["garissa", "wajir", "mandera"], "Somali"),
    (["narok", "kajiado"], "Maasai"),
]

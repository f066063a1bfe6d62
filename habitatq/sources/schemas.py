"""Fixed schemas of the survey inputs, so that nothing is inferred at read time."""

from __future__ import annotations

# DDL text. Column names as they stand after ``operators.clean.normalise_names``.
LARVAL_SURVEY = (
    "cruise_name string, station string, lat double, lon double, date string, sfc_temp double, "
    "hipobl_10m2 double, merbil_10m2 double, citarc_10m2 double, scoaqu_10m2 double"
)
CODED_TAXA = "cruise_name string, station string, taxa_ichthyo bigint, abundance double"
EGG_STATIONS = (
    "cruise_name string, station string, egg_count string, ich_haul_fctr string, latitude double, longitude double"
)
EGG_IDS = (
    "sample_id string, common_name string, cruise string, station string, egg_diameter_mm string"
)
HAUL_FACTORS = "cruise_name string, station string, ich_haul_fctr double"
CASTS = "cruise_name string, station string, octemps_sfc_temp double"
SIZE_SHEET = "bin double, unid_frequency double, id_frequency double"
BARCODES = "genus_species string, common_name string, cruise_id string, station_id string, stage string"
STATION_INFO = "cruise_id string, station_id string, sst_ctd string, tow_depth double"
STATION_VISITS = (
    "haul_id string, cruise_id string, station_id string, latitude double, longitude double"
)
WAYPOINTS = "waypoint string, latitude double, longitude double"
REPLICATES = "row_name string, temp_bin double, q double, data string, spp string"
DEPTH_GRID = "lon double, lat double, depth double"

"""Fixed schemas and fixed lookup values of the data model.

Every scan declares its schema, so no job ever starts with an inference pass.
"""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _I, _S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


RAW_TCE = _struct(
    kepid=_L,
    tce_plnt_num=_L,
    tce_cap_stat=_D,
    tce_hap_stat=_D,
    boot_fap=_D,
    tce_rb_tcount0=_D,
    tce_prad=_D,
    tcet_period=_D,
    tce_depth=_D,
    tce_time0bk=_D,
    tce_duration=_D,
    tce_period=_D,
    kepler_name=_S,
    label=_S,
    tce_maxmesd=_D,
    wst_depth=_D,
)

RAW_STELLAR = _struct(kepid=_L, teff=_D, dens=_D, logg=_D, feh=_D, radius=_D, mass=_D)

RAW_SERIES = _struct(
    KEPLERID=_L,
    QUARTER=_I,
    TIME=T.ArrayType(_D),
    PDCSAP_FLUX=T.ArrayType(_D),
    MOM_CENTR1=T.ArrayType(_D),
    MOM_CENTR2=T.ArrayType(_D),
)

OBSERVATIONS = _struct(
    target_id=_L, quarter=_I, seq=_L, time=_D, flux=_D, centroid_x=_D, centroid_y=_D
)

EVENT = _struct(epoch=_D, duration=_D, period=_D, secondary_phase=_D)

_VIEW = T.ArrayType(_D, False)

FEATURES = T.StructType(
    [
        T.StructField(name, _VIEW)
        for name in (
            "even_flux",
            "global_centroid_shift",
            "global_flux",
            "local_centroid_shift",
            "local_flux",
            "odd_flux",
            "secondary_flux",
        )
    ]
    + list(
        _struct(
            stellar_density=_D,
            stellar_effective_temperature=_D,
            stellar_id=_L,
            stellar_mass=_D,
            stellar_metallicity=_D,
            stellar_radius=_D,
            stellar_surface_gravity=_D,
            tce_bootstrap_false_alarm_proba=_D,
            tce_duration=_D,
            tce_epoch=_D,
            tce_fitted_period=_D,
            tce_id=_L,
            tce_label=_I,
            tce_name=_S,
            tce_opt_ghost_core_aperture_corr=_D,
            tce_opt_ghost_halo_aperture_corr=_D,
            tce_period=_D,
            tce_radius=_D,
            tce_rolling_band_fgt=_D,
            tce_secondary_phase=_D,
            tce_secondary_transit_depth=_D,
            tce_target_id=_L,
            tce_transit_depth=_D,
            id=_S,
        )
    )
)

VIEW_NAMES = tuple(f.name for f in FEATURES if isinstance(f.dataType, T.ArrayType))

# Label short code and its long form.
LABELS = {
    "PC": "PLANET_CANDIDATE",
    "NTP": "NON_TRANSITING_PHENOMENA",
    "AFP": "ASTROPHYSICAL_FALSE_POSITIVE",
    "UNKNOWN": "UNKNOWN",
    "FP": "FALSE_POSITIVE",
}

# Names given to the raw columns.
TCE_COLUMNS = {
    "tce_plnt_num": "tce_id",
    "kepid": "target_id",
    "kepler_name": "name",
    "tce_cap_stat": "opt_ghost_core_aperture_corr",
    "tce_hap_stat": "opt_ghost_halo_aperture_corr",
    "boot_fap": "bootstrap_false_alarm_proba",
    "tcet_period": "fitted_period",
    "tce_prad": "radius",
    "tce_rb_tcount0": "rolling_band_fgt",
    "tce_depth": "transit_depth",
    "wst_depth": "secondary_transit_depth",
}
EVENT_COLUMNS = {
    "tce_time0bk": "epoch",
    "tce_duration": "duration",
    "tce_period": "period",
    "tce_maxmesd": "secondary_phase",
}
STELLAR_COLUMNS = {
    "kepid": "id",
    "teff": "effective_temperature",
    "radius": "radius",
    "mass": "mass",
    "dens": "density",
    "logg": "surface_gravity",
    "feh": "metallicity",
}
SERIES_COLUMNS = {
    "KEPLERID": "target_id",
    "QUARTER": "quarter",
    "TIME": "time",
    "PDCSAP_FLUX": "flux",
    "MOM_CENTR1": "centroid_x",
    "MOM_CENTR2": "centroid_y",
}

# Display units of the parameter cards.
STELLAR_UNITS = {
    "effective_temperature": "K",
    "radius": "Solar radii",
    "mass": "Solar mass",
    "density": "gm/cm^3",
    "surface_gravity": "log10(cm/s^2)",
    "metallicity": "dex",
}
PLANET_UNITS = {
    "epoch": "days",
    "duration": "days",
    "period": "days",
    "radius": "Earth radii",
    "fitted_period": "days",
    "transit_depth": "ppm",
}

# Archive file-name prefixes, one group per observation quarter.
LONG_CADENCE_PREFIXES = """
2009131105131
2009166043257
2009259160929
2009350155506
2010078095331 2010009091648
2010174085026
2010265121752
2010355172524
2011073133259
2011177032512
2011271113734
2012004120508
2012088054726
2012179063303
2012277125453
2013011073258
2013098041711
2013131215648
""".split()
SHORT_CADENCE_PREFIXES = """
2009131110544
2009166044711
2009201121230 2009231120729 2009259162342
2009291181958 2009322144938 2009350160919
2010009094841 2010019161129 2010049094358 2010078100744
2010111051353 2010140023957 2010174090439
2010203174610 2010234115140 2010265121752
2010296114515 2010326094124 2010355172524
2011024051157 2011053090032 2011073133259
2011116030358 2011145075126 2011177032512
2011208035123 2011240104155 2011271113734
2011303113607 2011334093404 2012004120508
2012032013838 2012060035710 2012088054726
2012121044856 2012151031540 2012179063303
2012211050319 2012242122129 2012277125453
2012310112549 2012341132017 2013011073258
2013017113907 2013065031647 2013098041711
2013121191144 2013131215648
""".split()
CADENCE_PREFIXES = {"llc": LONG_CADENCE_PREFIXES, "slc": SHORT_CADENCE_PREFIXES}

# Fixed value: public archive the light-curve files come from.
ARCHIVE_URL = (
    "https://mast.stsci.edu/api/v0.1/Download/file?uri=mast:Kepler/url/missions/kepler/lightcurves"
)

# Knot spacings tried by the detrender (20 values, log-spaced 0.5 .. 20 days).
KNOT_SPACINGS = (
    0.5, 0.60714015, 0.73723832, 0.89521396, 1.08704067, 1.31997206, 1.60281606, 1.94626796,
    2.36331483, 2.86972662, 3.48465248, 4.23134484, 5.13803866, 6.23901909, 7.57591793,
    9.19928784, 11.17051394, 13.56413495, 16.47066176, 20.0,
)

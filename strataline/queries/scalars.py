"""Row-wise closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geophysics as G
from ..functions.formula import compile_formula
from ..functions.numbers import half_up, ratio
from .registry import scalar


def c(name: str):
    return F.col(name)


_NORMAL = "978032.67715 * (1 + 0.00193185138639 * pow(sin(radians(lat)), 2)) / sqrt(1 - 0.00669438002290 * pow(sin(radians(lat)), 2))"
_FAA = f"(g - {_NORMAL} + 0.3086 * h)"
_SLAB = "(0.0419 * 2.67 * h)"
_CURVE = "((1.4633e-3 * greatest(h, 0e0) - 3.533e-7 * pow(greatest(h, 0e0), 2) + 4.5e-14 * pow(greatest(h, 0e0), 3)))"
_PLATE = "(h * 2 * pi() * 6.67430e-6 * CASE WHEN h < 0 THEN 1640 ELSE 2670 END)"

scalar("normal_gravity_grs80", "stations", "id", {"normal": (lambda: G.normal_gravity(c("lat")), _NORMAL)})
scalar("gravity_disturbance_grs80", "stations", "id", {"disturbance": (lambda: c("g") - G.normal_gravity(c("lat")), f"g - {_NORMAL}")})
scalar("free_air_correction", "stations", "id", {"free_air": (lambda: G.free_air_correction(c("h")), "0.3086 * h")})
scalar("free_air_anomaly", "stations", "id", {"anomaly": (lambda: G.free_air_anomaly(c("g"), c("lat"), c("h")), _FAA)})
scalar("bullard_b_curvature", "stations", "id", {"bb": (lambda: G.curvature_b(c("h")), _CURVE)})
scalar("bouguer_correction", "stations", "id", {"effect": (lambda: G.plate_effect(c("h")), _PLATE)})
scalar("simple_bouguer_anomaly", "stations", "id", {"anomaly": (lambda: G.simple_bouguer(c("g"), c("lat"), c("h"), G.plate_effect(c("h"))), f"{_FAA} - {_PLATE}")})
scalar("complete_bouguer_anomaly", "stations", "id", {"anomaly": (lambda: G.complete_bouguer(c("g"), c("lat"), c("h"), G.plate_effect(c("h")), c("u")), f"{_FAA} - {_PLATE} + u - {_CURVE}")})
scalar(
    "land_gravity_reduction",
    "stations",
    "id",
    {
        "normal": (lambda: G.normal_gravity(c("lat")), _NORMAL),
        "free_air": (lambda: G.free_air_correction(c("h")), "0.3086 * h"),
        "slab": (lambda: G.slab_effect(c("h")), _SLAB),
        "free_air_anomaly": (lambda: G.free_air_anomaly(c("g"), c("lat"), c("h")), _FAA),
        "simple_bouguer": (lambda: G.free_air_anomaly(c("g"), c("lat"), c("h")) - G.slab_effect(c("h")), f"{_FAA} - {_SLAB}"),
    },
)
scalar("airy_isostatic_moho", "stations", "id", {"root": (lambda: G.airy_root(c("h")), "h * (2670e0 / 400e0)"), "moho": (lambda: G.airy_moho(c("h")), "25000 + h * (2670e0 / 400e0)")})
scalar("eotvos_correction", "stations", "id", {"eotvos": (lambda: G.eotvos(c("lat"), c("ve"), c("vn")), "(2 * 7.2921150e-5 * ve * cos(radians(lat)) + (ve * ve + vn * vn) / 6371008.8) * 1e5")})
scalar("linear_drift", "survey", "row_id", {"drift": (lambda: G.drift(c("t"), F.lit(1704067200.0), 0.25), "(t - 1704067200) * 0.25 / 3600")})
scalar("heading_correction", "stations", "id", {"heading": (lambda: G.heading_correction(c("az"), 2.5, -1.25), "cos(radians(az)) * 2.5 + sin(radians(az)) * -1.25")})
scalar("angular_difference", "stations", "id", {"difference": (lambda: G.angle_between(c("az"), c("lat")), "(((az - lat + 180) % 360) + 360) % 360 - 180")})
scalar("azimuth_from_velocity", "stations", "id", {"azimuth": (lambda: G.azimuth(c("ve"), c("vn")), "((degrees(atan2(ve, vn)) % 360) + 360) % 360")})
scalar(
    "rotate_velocity",
    "stations",
    "id",
    {"east": (lambda: G.true_velocity(c("ve"), c("vn"), 1.5)[0], "ve * cos(radians(1.5)) - vn * sin(radians(1.5))"), "north": (lambda: G.true_velocity(c("ve"), c("vn"), 1.5)[1], "ve * sin(radians(1.5)) + vn * cos(radians(1.5))")},
)
scalar(
    "magnetic_elements",
    "stations",
    "id",
    {
        "total": (lambda: G.magnetic_elements(c("ve"), c("vn"), c("h"))["total"], "sqrt(ve * ve + vn * vn + h * h)"),
        "horizontal": (lambda: G.magnetic_elements(c("ve"), c("vn"), c("h"))["horizontal"], "sqrt(ve * ve + vn * vn)"),
        "declination": (lambda: G.magnetic_elements(c("ve"), c("vn"), c("h"))["declination"], "degrees(atan2(ve, vn))"),
        "inclination": (lambda: G.magnetic_elements(c("ve"), c("vn"), c("h"))["inclination"], "degrees(atan2(-h, sqrt(ve * ve + vn * vn)))"),
    },
)
_T = lambda: [c(x) for x in ("k", "u", "th", "ve", "vn", "h")]
scalar(
    "tensor_invariants",
    "stations",
    "id",
    {
        "i1": (lambda: G.tensor_invariants(*_T())["i1"], "k + ve + h"),
        "i2": (lambda: G.tensor_invariants(*_T())["i2"], "k * ve + ve * h + h * k - u * u - vn * vn - th * th"),
        "i3": (lambda: G.tensor_invariants(*_T())["i3"], "k * (ve * h - vn * vn) - u * (u * h - vn * th) + th * (u * vn - ve * th)"),
    },
)
_R = [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
scalar(
    "rotate_tensor",
    "stations",
    "id",
    {n: ((lambda n=n: G.rotated_tensor(_T(), _R)[n]), sql) for n, sql in (("xx", "ve"), ("xy", "-u"), ("xz", "vn"), ("yy", "k"), ("yz", "-th"), ("zz", "h"))},
)

# gamma-ray spectrometry
scalar("radiometry_ratio", "stations", "id", {"ratio": (lambda: ratio(c("u"), c("th"), 0.5), "CASE WHEN abs(th) > 0.5 THEN u / th END")})
scalar("radiometry_dose_rate", "stations", "id", {"dose": (lambda: G.dose_rate(c("k"), c("u"), c("th")), "13.078 * k + 5.675 * u + 2.494 * th")})
scalar("radiometry_f_parameter", "stations", "id", {"f": (lambda: G.f_parameter(c("k"), c("u"), c("th")), "CASE WHEN abs(th) > 0 THEN k * u / th END")})
scalar("radiometry_live_time", "stations", "id", {"rate": (lambda: G.live_time(c("u"), c("az") * 3), "CASE WHEN az * 3 > 0 AND az * 3 <= 1000 THEN u * 1000 / (az * 3) END")})
scalar("radiometry_dead_time", "stations", "id", {"rate": (lambda: G.dead_time(c("g") / 1000, 1e-4), "(g / 1000) / (1 - 1e-4 * (g / 1000))")})
scalar("radiometry_background", "stations", "id", {"rate": (lambda: G.background(c("u"), c("k"), F.lit(0.25), c("th")), "u - k - 0.25 - th")})
scalar("radiometry_height_attenuation", "stations", "id", {"rate": (lambda: G.height_attenuation(c("u"), c("h"), 80.0, 0.005), "u * exp(0.005 * (h - 80))")})
scalar("radiometry_sensitivity_calibration", "stations", "id", {"value": (lambda: G.sensitivity(c("u"), 7.5, 0.4), "(u - 0.4) / 7.5")})
_M = [[1.0, 0.25, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 1.0]]  # inverse: k - u/4 + th/8, u - th/2, th
scalar(
    "radiometry_spectral_unmix",
    "stations",
    "id",
    {n: ((lambda i=i: G.unmix([c("k"), c("u"), c("th")], _M)[i]), sql) for i, (n, sql) in enumerate((("k0", "k - 0.25 * u + 0.125 * th"), ("u0", "u - 0.5 * th"), ("th0", "th")))},
)
scalar(
    "radiometric_survey_chain",
    "stations",
    "id",
    {
        "u_cps": (lambda: G.background(G.dead_time(c("u"), 1e-5), F.lit(0.1), c("k") / 10), "u / (1 - 1e-5 * u) - 0.1 - k / 10"),
        "u_ppm": (lambda: G.sensitivity(G.height_attenuation(G.background(G.dead_time(c("u"), 1e-5), F.lit(0.1), c("k") / 10), c("h"), 80.0, 0.006), 8.0), "(u / (1 - 1e-5 * u) - 0.1 - k / 10) * exp(0.006 * (h - 80)) / 8"),
    },
)

# electrics and magnetotellurics
scalar(
    "geometric_factor",
    "stations",
    "id",
    {"factor": (lambda: G.geometric_factor(c("k") + 1, c("u") + 2, c("th") + 3, F.when(c("id") % 5 > 0, c("k") + 9)), "2 * pi() / (1 / (k + 1) - 1 / (u + 2) - 1 / (th + 3) + CASE WHEN id % 5 > 0 THEN 1 / (k + 9) ELSE 0 END)")},
)
scalar("apparent_resistivity", "stations", "id", {"rho": (lambda: G.apparent_resistivity(c("ve"), c("u"), c("th")), "CASE WHEN th <> 0 THEN ve * (u / th) END")})
scalar(
    "cole_cole_resistivity",
    "stations",
    "id",
    {
        "re": (lambda: G.cole_cole(c("th"), 100.0, 0.3, 0.5, 0.5)[0], "100 * (0.7 + 0.3 * (1 + pow(pi() * th, 0.5) * cos(pi() / 4)) / (pow(1 + pow(pi() * th, 0.5) * cos(pi() / 4), 2) + pow(pow(pi() * th, 0.5) * sin(pi() / 4), 2)))"),
        "im": (lambda: G.cole_cole(c("th"), 100.0, 0.3, 0.5, 0.5)[1], "-100 * 0.3 * (pow(pi() * th, 0.5) * sin(pi() / 4)) / (pow(1 + pow(pi() * th, 0.5) * cos(pi() / 4), 2) + pow(pow(pi() * th, 0.5) * sin(pi() / 4), 2))"),
    },
)
scalar(
    "mt_apparent_resistivity_phase",
    "stations",
    "id",
    {"rho": (lambda: G.mt_resistivity(c("u"), c("ve") / 1000, c("vn") / 1000), "(ve * ve + vn * vn) / 1e6 / (2 * pi() * u * 4e-7 * pi())"), "phase": (lambda: G.mt_phase(c("ve"), c("vn")), "CASE WHEN ve <> 0 OR vn <> 0 THEN degrees(atan2(vn, ve)) END")},
)
scalar("mt_impedance_units", "stations", "id", {"ohm": (lambda: G.mt_units(c("g")), "g * (1000 * 4e-7 * pi())")})
_X, _Y = (lambda: [c("k") + 1, c("u"), c("ve"), c("h") + 200]), (lambda: [c("th"), c("vn"), c("k"), c("u")])
_DET = "((k + 1) * (h + 200) - u * ve)"
scalar(
    "mt_phase_tensor",
    "stations",
    "id",
    {
        n: ((lambda i=i: G.phase_tensor(_X(), _Y())[i]), f"CASE WHEN {_DET} <> 0 THEN ({sql}) / {_DET} END")
        for i, (n, sql) in enumerate((("xx", "(h + 200) * th - u * k"), ("xy", "(h + 200) * vn - u * u"), ("yx", "(k + 1) * k - ve * th"), ("yy", "(k + 1) * u - ve * vn")))
    },
)

# responses of the wavenumber
_W = "(2 * pi() / {})"
scalar("butterworth_lowpass", "stations", "id", {"gain": (lambda: G.butterworth_low(c("wave"), 50.0, 2), f"1 / sqrt(1 + pow(wave / {_W.format(50)}, 4))")})
_HIGH = f"CASE WHEN wave > 0 THEN 1 / sqrt(1 + pow({_W.format(80)} / wave, 4)) ELSE 0 END"
scalar("butterworth_highpass", "stations", "id", {"gain": (lambda: G.butterworth_high(c("wave"), 80.0, 2), _HIGH)})
scalar("butterworth_bandpass", "stations", "id", {"gain": (lambda: G.butterworth_high(c("wave"), 80.0, 2) * G.butterworth_low(c("wave"), 30.0, 2), f"{_HIGH} * (1 / sqrt(1 + pow(wave / {_W.format(30)}, 4)))".replace("CASE", "(CASE").replace("END *", "END) *"))})
scalar("butterworth_notch", "stations", "id", {"gain": (lambda: 1 - G.butterworth_high(c("wave"), 80.0, 2) * G.butterworth_low(c("wave"), 30.0, 2), f"1 - ({_HIGH}) * (1 / sqrt(1 + pow(wave / {_W.format(30)}, 4)))")})
scalar("ideal_bandpass", "stations", "id", {"gain": (lambda: G.ideal_band(c("wave"), 80.0, 30.0), f"CASE WHEN wave BETWEEN {_W.format(80)} AND {_W.format(30)} THEN 1 ELSE 0 END")})
scalar("ideal_band_reject", "stations", "id", {"gain": (lambda: 1 - G.ideal_band(c("wave"), 80.0, 30.0), f"CASE WHEN wave BETWEEN {_W.format(80)} AND {_W.format(30)} THEN 0 ELSE 1 END")})
_ROLL = f"CASE WHEN wave <= {_W.format(80)} THEN 1 WHEN wave >= {_W.format(30)} THEN 0 ELSE pow(cos(pi() / 2 * (wave - {_W.format(80)}) / ({_W.format(30)} - {_W.format(80)})), 2) END"
scalar("cosine_rolloff_lowpass", "stations", "id", {"gain": (lambda: G.cosine_rolloff(c("wave"), 80.0, 30.0, 2), _ROLL)})
scalar("cosine_rolloff_highpass", "stations", "id", {"gain": (lambda: 1 - G.cosine_rolloff(c("wave"), 80.0, 30.0, 2), f"1 - ({_ROLL})")})
_DIR = "CASE WHEN ke = 0 AND kn = 0 THEN 1 ELSE pow(abs(cos(atan2(ke, kn) - (radians(30) + pi() / 2))), 2) END"
scalar("directional_cosine_pass", "stations", "id", {"gain": (lambda: G.directional_cosine(c("ke"), c("kn"), 30.0, 2), _DIR)})
scalar("directional_cosine_reject", "stations", "id", {"gain": (lambda: 1 - G.directional_cosine(c("ke"), c("kn"), 30.0, 2), f"1 - ({_DIR})")})
scalar("downward_continuation_gain", "stations", "id", {"gain": (lambda: G.downward(c("wave"), 20.0, 50.0, 2, 40.0), f"exp(least(wave * 20, ln(40))) * (1 / sqrt(1 + pow(wave / {_W.format(50)}, 4)))")})
scalar("upward_continuation_gain", "stations", "id", {"gain": (lambda: G.upward(c("wave"), 20.0), "exp(-20 * wave)")})
scalar("vertical_integration_gain", "stations", "id", {"gain": (lambda: G.vertical_integration(c("wave")), "CASE WHEN wave > 0 THEN 1 / wave ELSE 0 END")})
scalar("gaussian_lowpass_gain", "stations", "id", {"gain": (lambda: G.gaussian_low(c("wave"), 50.0), f"exp(-0.5 * pow(wave / {_W.format(50)}, 2))")})
scalar(
    "wiener_inverse",
    "stations",
    "id",
    {n: ((lambda i=i: G.wiener_inverse(c("ke"), c("kn"), c("u"), c("k"))[i]), f"CASE WHEN (ke * ke + kn * kn) * u + k <> 0 THEN {sql} * u / ((ke * ke + kn * kn) * u + k) END") for i, (n, sql) in enumerate((("re", "ke"), ("im", "-kn")))},
)
scalar("explicit_time_gain", "stations", "id", {"value": (lambda: G.time_gain(c("u"), c("th"), 0.5, 1.5, 0.1, 60.0), "u * least(pow(1 + th / 0.5, 1.5) * exp(0.1 * th), 60)")})
scalar("half_up_bins", "stations", "id", {"bin": (lambda: half_up(c("ve") / 4), "floor(ve / 4 + 0.5)")})

_FORMULA = "(c('g') - 978000) ** 2 / c('th') + sqrt(c('ve')) - 2 * log10(abs(c('vn'))) + -c('k')"
scalar(
    "formula_channel",
    "stations",
    "id",
    {"value": (lambda: compile_formula(_FORMULA)[0], "CASE WHEN th <> 0 AND ve >= 0 AND vn <> 0 THEN pow(g - 978000, 2) / th + sqrt(greatest(ve, 0e0)) - 2 * log10(CASE WHEN vn = 0 THEN 1 ELSE abs(vn) END) - k END")},
)

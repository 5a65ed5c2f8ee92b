"""Operations by domain: the name of each and what carries it out.

A value takes Spark columns or tables (see its docstring) or, for kernels, NumPy arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import geophysics as geo
from ..functions import projection
from ..operators import fields, grids, joins, kernels, lines, models, solve, soundings, spectra, stats, tracks
from ..sources import text

# The operation names of the survey domain.
OPERATIONS: dict[str, Callable] = {
    "gravity.polygon_forward": kernels.polygon_gravity,
    "gravity.polygon_density_fit": solve.least_squares,
    "gravity.terrain_prisms": fields.terrain_effect,
    "gravity.prism_forward": fields.prism_gravity,
    "gravity.network_adjustment": solve.network,
    "gravity.density_fit": solve.least_squares,
    "gravity.tensor_invariants": geo.tensor_invariants,
    "gravity.rotate_tensor": geo.rotated_tensor,
    "radiometry.upward_window_radon": fields.upward_radon,
    "radiometry.background_correction": geo.background,
    "radiometry.energy_rebin": joins.overlaps,
    "radiometry.integrate_windows": joins.overlaps,
    "radiometry.nasvd": spectra.nasvd,
    "radiometry.mnf": spectra.mnf,
    "radiometry.full_spectrum_fit": kernels.nnls,
    "radiometry.covariance_transform": fields.covariance_transform,
    "radiometry.fit_response": kernels.gls,
    "radiometry.calibrated_concentrations": geo.linear_map,
    "radiometry.energy_calibration": solve.least_squares,
    "potential.empirical_variogram": joins.variogram,
    "potential.ordinary_kriging": kernels.ordinary_kriging,
    "potential.radial_filter": fields.tabulated,
    "potential.layer_response": fields.layer_response,
    "potential.apparent_property": fields.apparent_property,
    "potential.equivalent_sources": fields.equivalent_source_tiles,
    "magnetic.components": fields.component,
    "structural.phase": fields.monogenic,
    "structural.texture": stats.entropy,
    "structural.orientation_entropy": stats.entropy,
    "depth.euler_window": kernels.euler_window,
    "depth.werner_profile": kernels.werner_window,
    "em.fit_complex_response": kernels.gls,
    "em.apply_complex_response": fields.complex_response,
    "regional.elastic_flexure": grids.airy_flexure,
    "regional.admittance_coherence": kernels.admittance,
    "waveform.bandpass": kernels.zero_phase,
    "gpr.time_gain": geo.time_gain,
    "gpr.time_zero": joins.interpolate,
    "seismic.sta_lta_picks": lines.first_crossing,
    "passive.hvsr": fields.hvsr,
    "passive.phase_velocity": fields.phase_velocity,
    "sp.reference_network": solve.network,
    "borehole.trajectory": lines.trajectory,
    "borehole.read_las": text.read_las,
    "borehole.update_las": text.write_las,
    "spectra.grid_psd": grids.block_spectra,
    "spectra.directional_bins": grids.radial_spectrum,
    "spectra.wiener_inverse": geo.wiener_inverse,
    "tem.integrate_recorded_gates": fields.piecewise_mean,
    "electrical.geometric_factor": geo.geometric_factor,
    "electrical.apparent_resistivity": geo.apparent_resistivity,
    "electrical.reciprocal_qc": joins.reciprocal_errors,
    "ip.integrated_chargeability": fields.piecewise_mean,
    "sip.cole_cole_resistivity": geo.cole_cole,
    "sip.fit_cole_cole": kernels.fit_bounded,
    "mt.layered_forward": kernels.layered_impedance,
    "mt.apparent_resistivity_phase": geo.mt_resistivity,
    "mt.impedance_units": geo.mt_units,
    "mt.phase_tensor": geo.phase_tensor,
    "inversion.spatial_constraints": fields.inside_boxes,
    "inversion.recovery_metrics": grids.compare,
    "inversion.reference_doi": fields.depth_of_investigation,
    "inversion.linear_resolution": models.posterior,
    "inversion.linear_ensemble": models.ensemble,
    "inversion.stochastic_resolution": models.stochastic_resolution,
    "inversion.point_spread": models.point_spread,
    "radiometry.window_radon": models.window_radon,
    "radiometry.full_spectrum_radon": models.full_spectrum_radon,
    "radiometry.paired_radon": models.paired_radon,
    "gravity.prism_tensor": models.prism_tensor,
    "gravity.prism_density_fit": models.fit_rows,
    "magnetic.prism_magnetization_fit": models.fit_rows,
    "magnetic.dipole_fit": models.fit_dipole,
    "magnetic.gradient_tmi": models.field_from_gradients,
    "magnetic.igrf": models.main_field,
    "potential.reproject_xy": projection.reproject,
    "regional.elastic_thickness_scan": models.thickness_scan,
    "gpr.hyperbola_fit": models.fit_hyperbola,
    "depth.euler_profile": models.euler_profile,
    "depth.interpret_grid": kernels.werner_profile,
    "structural.skeleton_paths": models.skeleton_paths,
    "survey.crossovers": tracks.crossovers,
    "electrical.layered_forward": soundings.layered_resistance,
    "electrical.fit_resistivity": soundings.fit_layers,
    "ip.cole_cole_decay": soundings.ip_decay,
    "ip.fit_decay": soundings.fit_ip,
    "ip.stack_decay": soundings.ip_stack,
    "ip.fit_stack": soundings.fit_ip,
    "ip.waveform_decay": soundings.ip_waveform,
    "ip.fit_waveform": soundings.fit_ip,
    "ip.dispersive_forward": soundings.dispersive_response,
    "ip.dispersive_inverse": soundings.fit_cells,
    "ip.spatial_waveform": soundings.spatial_waveform,
    "ip.fit_spatial_waveform": soundings.fit_cells,
    "fdem.layered_forward": soundings.fdem_layered,
    "fdem.fit_conductivity": soundings.fit_layers,
    "tem.stepoff_forward": soundings.tem_stepoff,
    "tem.waveform_forward": soundings.tem_waveform,
    "tem.gate_average": soundings.tem_gates,
    "tem.fit_conductivity": soundings.fit_layers,
    "mt.fit_resistivity": soundings.fit_layers,
}


def find(part: str) -> list[str]:
    """Names that have ``part`` in them."""
    return sorted(n for n in OPERATIONS if part in n)

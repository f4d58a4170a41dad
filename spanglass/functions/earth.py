"""The turning and moving Earth: sidereal time, rise and set, and the Doppler factors between spectral frames.

Everything is a Column expression of a time (modified Julian date, UT), so it is evaluated row by row in generated code.  The series are
short ones: sidereal time is good to 0.05 s, the Earth's velocity to some metres a second, that is a part in 10^8 of a frequency.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanglass.functions.sky import C, OBLIQUITY, cosines

TURN = 1.00273790935  # sidereal days in a day
J2000 = 51_544.5
#: Velocities of the frames' origins towards J2000 directions, in m/s (speed times direction cosines).
VELOCITIES = {
    "LSRK": tuple(20_000.0 * v for v in (0.0145021, -0.865863, 0.500071)),
    "LSRD": tuple(math.sqrt(274) * 1000 * v for v in (-0.0385568, -0.881138, 0.471285)),
    "GALACTO": tuple(220_000.0 * v for v in (0.494109, -0.44483, 0.746982)),
    "LGROUP": tuple(308_000.0 * v for v in (0.593553979227, -0.177954636914, 0.784873124106)),
    "CMB": tuple(369_500.0 * v for v in (-0.97176985257, 0.202393953108, -0.121243727187)),
}
#: The frame that each is told from, towards the barycentre of the solar system.
ABOVE = {"REST": "LSRK", "LSRK": "BARY", "LSRD": "BARY", "GALACTO": "LSRD", "LGROUP": "BARY", "CMB": "BARY", "GEO": "BARY", "TOPO": "GEO"}


def _degrees(x: Column) -> Column:
    return F.radians(F.pmod(x, F.lit(360.0)))


def mean_sidereal(mjd: Column) -> Column:
    """Greenwich mean sidereal time, an angle in [0, 2 pi)."""
    d = mjd - J2000
    t = d / 36_525.0
    return _degrees(280.46061837 + 360.98564736629 * d + t * t * (0.000387933 - t / 38_710_000.0))


def equation_of_equinoxes(mjd: Column) -> Column:
    """Apparent less mean sidereal time, by the four largest terms of nutation."""
    t = (mjd - J2000) / 36_525.0
    node, sun, moon = _degrees(125.04452 - 1934.136261 * t), _degrees(280.4665 + 36_000.7698 * t), _degrees(218.3165 + 481_267.8813 * t)
    arcsec = -17.2 * F.sin(node) - 1.32 * F.sin(2 * sun) - 0.23 * F.sin(2 * moon) + 0.21 * F.sin(2 * node)
    obliquity = F.radians(23.4392911 - 0.0130042 * t + (9.2 * F.cos(node) + 0.57 * F.cos(2 * sun) + 0.1 * F.cos(2 * moon) - 0.09 * F.cos(2 * node)) / 3600)
    return F.radians(arcsec / 3600) * F.cos(obliquity)


def apparent_sidereal(mjd: Column, lon: Column | float = 0.0) -> Column:
    """Local apparent sidereal time at an eastern longitude, an angle in [0, 2 pi)."""
    return F.pmod(mean_sidereal(mjd) + equation_of_equinoxes(mjd) + lon, F.lit(2 * math.pi))


def sidereal_seconds(mjd: Column, lon: Column | float = 0.0) -> Column:
    """The same as seconds of the sidereal day."""
    return apparent_sidereal(mjd, lon) * (43_200 / math.pi)


def hour_angle(mjd: Column, lon: Column | float, ra: Column) -> Column:
    """In [-pi, pi)."""
    return F.pmod(apparent_sidereal(mjd, lon) - ra + math.pi, F.lit(2 * math.pi)) - math.pi


def azimuth_elevation(mjd: Column, lon: Column | float, lat: Column, ra: Column, dec: Column) -> tuple[Column, Column]:
    """Azimuth from north over east in [0, 2 pi), and elevation, of a direction of date."""
    h = hour_angle(mjd, lon, ra)
    up = F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(h)
    east = -F.cos(dec) * F.sin(h)
    north = F.cos(lat) * F.sin(dec) - F.sin(lat) * F.cos(dec) * F.cos(h)
    return F.pmod(F.atan2(east, north), F.lit(2 * math.pi)), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up)))


def parallactic_angle(mjd: Column, lon: Column | float, lat: Column, ra: Column, dec: Column) -> Column:
    h = hour_angle(mjd, lon, ra)
    return F.atan2(F.cos(lat) * F.sin(h), F.sin(lat) * F.cos(dec) - F.cos(lat) * F.sin(dec) * F.cos(h))


def rise_and_set_in_day(mjd: Column, lon: Column | float, lat: Column, ra: Column, dec: Column, horizon: float = 0.0) -> tuple[Column, Column]:
    """When a direction of date next rises, from the beginning of the day on, and when it sets after that, in days from the day's beginning.

    What never sets has 1 and 0, what never rises 0 and 1.  Told as a date, a time has lost what is below a microsecond, and with it some roundings.
    """
    day = F.floor(mjd + 1e-6).cast("double")
    low = (math.sin(horizon) - F.sin(lat) * F.sin(dec)) / (F.cos(lat) * F.cos(dec))
    half = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), low)))
    at = lambda angle: F.pmod(angle - apparent_sidereal(day, lon), F.lit(2 * math.pi)) / (2 * math.pi * TURN)
    rise, fall = at(ra - half), at(ra + half)
    fall = F.when(fall < rise, fall + 1 / TURN).otherwise(fall)
    always, never = low <= -1, low >= 1
    return F.when(always, 1.0).when(never, 0.0).otherwise(rise), F.when(always, 0.0).when(never, 1.0).otherwise(fall)


def rise_and_set(mjd: Column, lon: Column | float, lat: Column, ra: Column, dec: Column, horizon: float = 0.0) -> tuple[Column, Column]:
    """The same as MJD: what never sets has the day's end and beginning, what never rises its beginning and end."""
    day = F.floor(mjd + 1e-6).cast("double")
    rise, fall = rise_and_set_in_day(mjd, lon, lat, ra, dec, horizon)
    return day + rise, day + fall


# ---- spectral frames


def earth_velocity(mjd: Column) -> list[Column]:
    """Velocity of the Earth from the barycentre of the solar system, J2000 equatorial, in m/s.

    A Kepler orbit of the centre of Earth and Moon, the Moon's share, and the Sun's motion that Jupiter and Saturn cause.
    """
    d = mjd - J2000
    t = d / 36_525.0
    g = _degrees(357.528 + 0.9856003 * d)
    true = _degrees(100.46 + 0.9856091 * d + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    near, e = F.radians(102.937 + 0.323 * t), 0.016709
    turn = lambda longitude, speed: (-speed * F.sin(longitude), speed * F.cos(longitude))
    parts = [turn(true, 29_788.9), turn(near, 29_788.9 * e), turn(_degrees(218.317 + 481_266.48 * t), -12.44), turn(_degrees(34.35 + 3034.906 * t), -12.47), turn(_degrees(50.08 + 1222.114 * t), -2.76)]
    x, y = (sum((p[i] for p in parts[1:]), parts[0][i]) for i in (0, 1))
    return [x, y * math.cos(OBLIQUITY), y * math.sin(OBLIQUITY)]


def _along(velocity: list, direction: list[Column]) -> Column:
    """The part of a velocity towards a direction, in units of light's."""
    return sum((d * v for v, d in zip(velocity[1:], direction[1:], strict=True)), direction[0] * velocity[0]) / C


def shift(beta: Column) -> Column:
    return F.sqrt((1 + beta) / (1 - beta))


def _towards(frame: str, ra: Column, dec: Column, mjd: Column | None, site: tuple | None, velocity: Column | None) -> Column:
    """beta of the step from a frame to the one above it."""
    direction = cosines(ra, dec)
    if frame == "REST":
        if velocity is None:
            raise ValueError("the rest frame needs a radial velocity")
        return -velocity / C
    if frame in VELOCITIES:
        sign = 1 if frame != "GEO" else -1
        return sign * _along(VELOCITIES[frame], direction)
    if mjd is None:
        raise ValueError(f"{frame} needs a time")
    if frame == "GEO":
        return -_along(earth_velocity(mjd), direction)
    if site is None:
        raise ValueError(f"{frame} needs a site (longitude, latitude, radius in metres)")
    lon, lat, radius = site
    last = apparent_sidereal(mjd, lon)
    speed = 2 * math.pi * radius / 86_400.0 * TURN
    return -_along([-F.sin(last) * speed * F.cos(lat), F.cos(last) * speed * F.cos(lat), F.lit(0.0)], direction)


def frame_factor(source: str, to: str, ra: Column, dec: Column, mjd: Column | None = None, site: tuple | None = None, velocity: Column | None = None) -> Column:
    """What a frequency in one spectral frame is multiplied by in another, for a J2000 direction.

    Frames are REST, LSRK, LSRD, GALACTO, LGROUP, CMB, BARY, GEO and TOPO.  GEO and TOPO need a time, TOPO a site (eastern longitude and
    geocentric latitude in radians, radius in metres; the direction is taken as one of date there), REST the source's
    radial velocity in LSRK, in m/s.
    """
    for f in (source, to):
        if f not in ABOVE and f != "BARY":
            raise ValueError(f"no frame {f!r}")
    up, down = [source], [to]
    for path in (up, down):
        while path[-1] != "BARY":
            path.append(ABOVE[path[-1]])
    while len(up) > 1 and len(down) > 1 and up[-2] == down[-2]:
        up.pop()
        down.pop()
    factor = F.lit(1.0)
    for frame in up[:-1]:
        factor = factor * shift(_towards(frame, ra, dec, mjd, site, velocity))
    for frame in reversed(down[:-1]):
        factor = factor * shift(-_towards(frame, ra, dec, mjd, site, velocity))
    return factor

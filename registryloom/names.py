"""Column names as one value, so every operator works on snake_case or on display headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its exact name; headers may hold dots, slashes and brackets."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Names:
    # source A, the wide trial sheet
    trial_id: str = "trial_id"
    protocol_id: str = "protocol_trial_id"
    title: str = "trial_title"
    phase: str = "trial_phase"
    status: str = "trial_status"
    area: str = "therapeutic_area"
    disease: str = "disease"
    sponsor: str = "sponsor"
    sponsor_fallback: str = "sponsor_collaborator"
    sponsor_type: str = "sponsor_type"
    design: str = "study_design"
    plan: str = "treatment_plan"
    keywords: str = "study_keywords"
    age_group: str = "patient_age_group"
    region: str = "trial_region"
    start: str = "start_date"
    modified: str = "last_modified_date"
    # source B, the public registry file
    public_id: str = "nct_id"
    sex: str = "sex"
    gender: str = "patient_gender"
    interventions: str = "interventions"
    public_title: str = "study_title"
    public_status: str = "study_status"
    condition: str = "condition"
    # derived
    registry_id: str = "nct_id"
    child: str = "child"
    adult: str = "adult"
    older_adults: str = "older_adults"
    clean_sponsor_type: str = "clean_sponsor_type"
    sponsor_tag: str = "sponsor_tag"
    study_type: str = "study_type"
    lead_sponsor: str = "lead_sponsor"
    standard_name: str = "standard_name"
    us_segment: str = "us_segment"
    ww_segment: str = "ww_segment"
    start_year: str = "start_year"
    start_month: str = "start_month"
    area_tag: str = "area_tag"
    covid_tag: str = "covid_tag"
    phase_tag: str = "phase_tag"
    region_tag: str = "region_tag"
    healthy_tag: str = "healthy_tag"

    @property
    def right_columns(self) -> list[str]:
        """Source B columns that the join brings over by default."""
        return [
            self.registry_id,
            self.public_title,
            self.public_status,
            self.interventions,
            self.condition,
        ]


# Headers as the source files spell them (after the sheet's renames, see sources.headers).
DISPLAY = Names(
    trial_id="Trial ID",
    protocol_id="Protocol_Trial_ID",
    title="Trial Title",
    phase="Trial Phase",
    status="TT_Trial Status",
    area="Therapeutic Area",
    disease="Disease",
    sponsor="TT_Sponsor/Collaborator",
    sponsor_fallback="Sponsor/Collaborator",
    sponsor_type="Sponsor/Collaborator Type",
    design="TT_Study Design",
    plan="Treatment Plan",
    keywords="Study Keywords",
    age_group="Patient Age Group",
    region="Trial Region",
    start="Start Date",
    modified="Last Modified Date",
    public_id="NCT id",
    gender="Patient Gender",
    public_title="study title",
    public_status="study status",
    registry_id="NCT ID",
    clean_sponsor_type="Cleaned Sponsor/Collaborator Type",
    sponsor_tag="Cleaned Sponsor/Collaborator Type_tagged",
    study_type="Study Type",
    lead_sponsor="Lead Sponsor",
    standard_name="EP Standard Name",
    us_segment="US company segmentation",
    ww_segment="WW company segmentation",
    start_year="Start Year",
    start_month="Start Month",
    area_tag="Therapeutic Area Tag",
    covid_tag="Covid Tag",
    phase_tag="Phase Tag",
    region_tag="Trial Region Tag",
    healthy_tag="Healthy Patient",
)
